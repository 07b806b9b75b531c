"""Code lists, word lists and patterns that results must agree on.

Code lists, phrases and state names are fixed values, stated as they are. Mail notices and signatures
are changed in form: each is two halves between which any text may stand, brand words are open,
and two French notices that differ by one phrase are one entry with that phrase optional.
"""

# fixed values: the closed set of case categories, with group and risk level
REASON_CODES = {
    "TrueDNR": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "Confirmed_Delay": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "Delivery_Attempt_Failed": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "Seller_Unable_To_Ship": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "PDA_Undeliverable": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "PDA_Early_Refund": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "Buyer_Received_WrongORDefective_Item": ("B", "Return + Refund Cases", "Medium Risk"),
    "Returnless_Refund": ("B", "Return + Refund Cases", "Medium Risk"),
    "BuyerCancellation": ("A", "Refund-Only Cases", "Highest Abuse Risk"),
    "Return_NoLongerNeeded": ("B", "Return + Refund Cases", "Medium Risk"),
    "Product_Information_Support": ("C", "Information/Support Only", "Lowest Risk"),
    "Insufficient_Information": ("C", "Information/Support Only", "Lowest Risk"),
}

# fixed values: evidence sections of a labelling response, in report order
EVIDENCE_SECTIONS = (
    "Message Evidence",
    "Shipping Evidence",
    "Timeline Evidence",
    "Primary Factors",
    "Supporting Evidence",
    "Contradicting Evidence",
)

# fixed values: stock phrases that carry no evidence
STOCK_EVIDENCE = (
    "None",
    "Unable to parse detailed shipping evidence",
    "Unable to parse detailed message evidence",
    "Unable to parse detailed timeline evidence",
    "Fallback analysis based on keywords",
    "Fallback classification due to parsing error",
)

# fixed values: message topic codes
TOPICS = {
    0: "MISSING",
    1: "ORDER_INFO_BUYER_TO_SELLER",
    2: "PRODUCT_DETAILS_BUYER_TO_SELLER",
    3: "SHIPPING_BUYER_TO_SELLER",
    4: "RETURN_POLICY_BUYER_TO_SELLER",
    5: "OTHER_BUYER_TO_SELLER",
    6: "ORDER_INFO_SELLER_TO_BUYER",
    7: "SHIPMENT_NOTIFICATION_SELLER_TO_BUYER",
    8: "FEEDBACK_REQUEST_SELLER_TO_BUYER",
    9: "RETURN_POLICY_SELLER_TO_BUYER",
    10: "REFUND_NOTICE_SELLER_TO_BUYER",
    11: "ADDITIONAL_INFO_SELLER_TO_BUYER",
    12: "ORDER_INFO_CBA_BUYER_TO_SELLER",
    13: "PRODUCT_DETAILS_CBA_BUYER_TO_SELLER",
    14: "SHIPPING_CBA_BUYER_TO_SELLER",
    15: "RETURN_POLICY_CBA_BUYER_TO_SELLER",
    16: "RETURNS_AND_REFUNDS_CBA_BUYER_TO_SELLER",
    17: "RECEIVED_DAMAGED_DEFECTIVE_WRONG_ITEM_CBA_BUYER_TO_SELLER",
    18: "WHERES_MY_STUFF_CBA_BUYER_TO_SELLER",
    19: "CANCEL_ORDER_CBA_BUYER_TO_SELLER",
    20: "OTHER_CBA_BUYER_TO_SELLER",
    21: "ORDER_INFO_CBA_SELLER_TO_BUYER",
    22: "SHIPMENT_NOTIFICATION_CBA_SELLER_TO_BUYER",
    23: "FEEDBACK_REQUEST_CBA_SELLER_TO_BUYER",
    24: "RETURN_POLICY_CBA_SELLER_TO_BUYER",
    25: "REFUND_NOTICE_CBA_SELLER_TO_BUYER",
    26: "ADDITIONAL_INFO_CBA_SELLER_TO_BUYER",
    27: "WHERES_MY_STUFF_BUYER_TO_SELLER",
    28: "RECEIVED_DAMAGED_DEFECTIVE_WRONG_ITEM_BUYER_TO_SELLER",
    29: "CANCEL_ORDER_BUYER_TO_SELLER",
    31: "THANK_YOU_BUYER_TO_SELLER",
    32: "COD_WRONG_CHARGE_BUYER_TO_SELLER",
    33: "RECEIVED_DAMAGED_DEFECTIVE_ITEM_BUYER_TO_SELLER",
    34: "RECEIVED_WRONG_ITEM_BUYER_TO_SELLER",
    35: "OTHER_SHIPPING_BUYER_TO_SELLER_POST_ORDER",
    36: "RETURN_POLICY_BUYER_TO_SELLER_POST_ORDER",
    37: "PRODUCT_DETAILS_BUYER_TO_SELLER_POST_ORDER",
    38: "OTHER_BUYER_TO_SELLER_POST_ORDER",
    39: "INCOMPLETE_SHIPMENT_BUYER_TO_SELLER_POST_ORDER",
    40: "OTHER_SHIPPING_CBA_BUYER_TO_SELLER_POST_ORDER",
    41: "RETURN_POLICY_CBA_BUYER_TO_SELLER_POST_ORDER",
    42: "RETURNS_AND_REFUNDS_CBA_BUYER_TO_SELLER_POST_ORDER",
    43: "PRODUCT_DETAILS_CBA_BUYER_TO_SELLER_POST_ORDER",
    44: "OTHER_CBA_BUYER_TO_SELLER_POST_ORDER",
    45: "INCOMPLETE_SHIPMENT_CBA_BUYER_TO_SELLER_POST_ORDER",
    46: "PRODUCT_CUSTOMIZATION_BUYER_TO_SELLER",
    47: "PRODUCT_CUSTOMIZATION_CBA_BUYER_TO_SELLER",
    49: "SHIP_FASTER_BUYER_TO_SELLER_POST_ORDER",
    50: "CHANGE_SHIPPING_ADDRESS_BUYER_TO_SELLER_POST_ORDER",
    51: "PWO_PACKAGE_DIDNT_ARRIVE_REQUEST_REFUND",
    52: "PWO_PACKAGE_DIDNT_ARRIVE_REQUEST_REPLACEMENT",
    53: "PWO_DAMAGED_OR_DEFECTIVE_REQUEST_REFUND",
    54: "PWO_DAMAGED_OR_DEFECTIVE_REQUEST_REPLACEMENT",
    55: "PWO_DIFFERENT_FROM_ORDERED_REQUEST_REFUND",
    56: "PWO_DIFFERENT_FROM_ORDERED_REQUEST_REPLACEMENT",
}

# fixed values: where a message was written
ENTRY_POINTS = {
    -1: "MISSING",
    0: "UNDEFINED",
    1: "BUYER_MAIL_UI",
    2: "SELLER_MAIL_UI",
    3: "ORDER_HISTORY_PAGE",
    4: "OFFER_LISTING_PAGE",
    5: "MERCHANT_RETURN_SERVICE",
    6: "CN_INVOICE",
    7: "ANYWHERE_HELP",
    8: "DISPUTE_MANAGEMENT",
    9: "MAGAZINES",
    10: "BBC_TEST",
    11: "CS_CENTRAL",
    12: "MAKE_AN_OFFER",
    13: "SELLER_MOBILE_MAIL_UI",
    14: "BUYER_CUSTOMER_SERVICE",
    15: "CONTACT_SELLER_UI",
    16: "ATHENA",
    17: "ACTION_CENTER",
    18: "PROBLEM_WITH_YOUR_ORDER_PAGE",
    19: "BUYER_DESKTOP_UI",
    20: "3P_Developer_API",
    21: "SMART_CS",
    22: "BUYER_THREADED_UI",
}

# fixed values: claim and customer actions to classes
CLAIM_ACTIONS = {
    "": 0, "GRNT": 0, "NOGR": 1, "SRFD": 0, "BWDR": 1, "INVG": 2, "HOLD": 2, "CBCK": 1,
    "SCAN": 0, "ACAN": 2, "BWDQ": 1, "RABI": 2, "RASI": 2, "BCNF": 2, "APAY": 2, "SPAY": 0,
}
CUSTOMER_ACTIONS = {"": 0, "FLUSH": 0, "NOT_QUALIFY": 0, "PASS": 0, "SOLICIT": 1, "WARN": 1, "CLOSE": 1}

# fixed values: combined label for (row, column) labels 0, 1, 2
LABEL_COMBINATION = ((0.0, 1.0, 2.0), (1.0, 1.0, 1.0), (2.0, 1.0, 2.0))

# fixed values: tokens without information
NONINFORMATIVE_TOKENS = (
    "dear", "hi", "hello", "mr", "mrs.", "customer", "pleasure", "sorry", "however", "appreciation",
    "hear", "inconvenience", "hope", "thank", "thanks", "appreciated", "sincerely", "best", "wishes",
    "yours", "apology", "consideration", "regards", "truely", "person", "product", "cardinal",
)

# fixed values: openings of a letter by language
GREETINGS = {
    "en": ("Dear", "Hi", "Hello", "Mr", "Mrs", "Greetings", "To Whom It May Concern", "Hey"),
    "fr": (
        "Bonjou", "Chers", "Chère", "Cher", "Chères", "Mon cher", "Ma très chère", "Monsieur", "Madame",
        "Mademoiselle", "Messieurs",
    ),
    "de": ("Guten Tag", "Hallo", "Sehr geehrter", "Liebe", "Lieber"),
    "nl": ("Hallo", "Beste"),
    "pt": ("Prezados", "Olá"),
    "it": ("Gentili", "Gentile Venditore"),
    "es": ("Estimados", "Hola"),
    "tr": ("Sayın", "Merhaba"),
    "sv": ("Kära",),
}

# fixed values: closings of a letter by language
FAREWELLS = {
    "en": (
        "Best", "Cordially yours", "Best regards", "Best wishes", "Fond regards", "In appreciation",
        "In sympathy", "Kind regards", "Kind thanks", "Many thanks", "Regards", "Respectfully",
        "Respectfully yours", "Sincerely", "Sincerely yours", "Thanks", "Thank you", "Thank you for your",
        "Warm regards", "Warm wishes", "With appreciation", "With deepest sympathy", "With gratitude",
        "Your help is greatly appreciated", "Yours cordially", "Yours sincerely", "Yours truly",
        "Yours faithfully", "have a wonderful day", "please feel free to", "your reply",
    ),
    "fr": (
        "Cordialement", "Cordialement à vous", "Chaleureusement", "Bien amicalement", "Amitiés", "Bien à vous",
        "Meilleures salutations", "Je vous envoie mes amicales pensées",
        "Recevez, je vous prie, mes meilleures amitiés", "À bientôt", "affectueuses pensées",
        "Bien à vous, Bien à toi", "Affectueusement",
    ),
    "de": (
        "Freundliche Grüße", "Mit freundlichen Grüßen", "Hochachtungsvoll", "Mit besten Grüßen",
        "Mit freundlichen Empfehlungen", "Beste Wünsche", "Dein", "Deine", "In Liebe", "Viele Grüße",
        "Herzlichst", "Ich danke Ihnen für Ihre Aufmerksamkeit und verbleibe mit freundlichen Grüßen",
        "Ich freue mich auf Ihre Antwort",
    ),
    "es": (
        "Atenciosamente", "Muy atentamente", "Muy cordialmente", "Un saludo", "Un saludo cordial",
        "Saludos cordiales", "Saludos",
    ),
    "pt": (
        "Atentamente", "Saudações cordiais", "Com os melhores cumprimentos", "Grato", "Agradeço desde já",
        "Aguardo sua resposta", "Respeitosamente",
    ),
    "it": (
        "Cordialmente", "Cordiali saluti", "Cordiali Saluti", "Un Cordiale Saluto", "Grazie e Cordiali Saluti",
        "Le porgo i miei distinti saluti", "La prego di voler gradire i miei più distinti saluti",
        "Distinti Saluti",
        "Ringraziando anticipatamente per la sempre cortese collaborazione porgo cordiali saluti",
    ),
    "ja": ("をよろしくお願いいたします",),
    "tr": ("Saygılarımızla",),
    "nl": ("Met vriendelijke groet",),
    "sv": ("Med vänliga hälsningar",),
}

# fixed values: header pattern and its end marker in service mails, by language
SERVICE_HEADERS = {
    "en": (r"Order\s*(?:#|Number|number):", "Details:"),
    "fr": (r"Numéro de commande:", "Détails:"),
    "de": (r"Bestellnummer\s*:", "Weitere Angaben:"),
    "pt": (r"Número do pedido\s*:", "Detalhes:"),
    "es": (r"Número de pedido\s*:", "Detalles:"),
    "mx": (r"Pedido\s*#:", "Detalles:"),
    "it": (r"Ordine\s*(?:#|Numero):", "Dettagli:"),
    "ja": (r"注文番号\s*:", "詳細:"),
    "tr": (r"Sipariş numarası\s*:", "Ayrıntılar:"),
    "nl": (r"Bestelnummer\s*:", "Details:"),
    "pl": (r"Numer zamówienia\s*:", "Szczegóły:"),
}

# fixed values: signature opening and closing words in service mails, by language
SERVICE_SIGNATURES = {
    "en": (
        "To respond to this customer, please reply to this e-mail or visit your seller account at the following link:",
        "Sincerely",
    ),
    "ja": (
        "購入者様へのご連絡は、直接こちらのメールにご返信いただくか、以下セラーアカウントからご返信ください。",
        "今後とも.*をよろしくお願いいたします",
    ),
    "fr": (
        "Nous vous remercions de répondre directement à ce client en répondant à cet e-mail ou en vous rendant dans votre compte vendeur:",
        "Cordialement",
    ),
    "de": (
        "Um Ihren Käufer zu kontaktieren, antworten Sie bitte auf diese E-Mail oder besuchen Sie Ihr Verkäuferkonto über folgenden Link:",
        "Freundliche Grüße",
    ),
    "pt": ("Para entrar em contato com este cliente, acesse sua conta de vendedor pelo link:", "Atenciosamente"),
    "es": (
        "Para responder al cliente,  por favor responde a este email o bien visita tu cuenta de vendedor en el siguiente enlace:",
        "Atentamente",
    ),
    "mx": (
        "Para enviarle una respuesta al cliente, por favor responde a este correo o visita tu cuenta de vendedor en el siguiente enlace:",
        "Cordialmente",
    ),
    "it": (
        "Per rispondere a questo cliente, risponda a quest'e-mail oppure utilizzi il suo account venditore cliccando sul seguente link:",
        "Cordiali saluti",
    ),
    "tr": (
        "Bu müşteriye cevap vermek için lütfen bu e-postayı yanıtlayın veya aşağıdaki bağlantıdan satıcı hesabınızı ziyaret edin:",
        "Saygılarımızla",
    ),
    "nl": (
        "Je kunt de klant antwoorden door op deze e-mail te reageren. Je kunt ook reageren via je verkopersaccount:",
        "Met vriendelijke groet",
    ),
    "pl": (
        "Aby skontaktować się z tym klientem, proszę odpowiedzieć na ten e-mail lub odwiedzić swoje konto sprzedawcy pod następującym adresem:",
        "Z poważaniem",
    ),
}

# fixed values: marker that ends the header of a return notice, by language
RETURN_REASON_MARKERS = {
    "en": "Return reason:",
    "fr": "Raison du retour:",
    "pt": "Razão para a devolução:",
    "de": "Rücksendegrund:",
    "mx": "Motivo de la devolución:",
    "it": "Motivo del reso:",
    "tr": "İade nedeni:",
    "nl": "Reden voor retourneren:",
    "sv": "Anledning till retur:",
    "ja": "返品理由:",
}

# fixed values: opening sentence of a return notice, by language (regular expressions)
RETURN_NOTICES = {
    "en": r"(?m:^(?:Dear )?).* and .*[:,]\s+This (?:email|note) is being sent to you by .* to notify and confirm that a return authorization has been requested for the item(?:\(s\))* listed below",
    "fr": r"Chers .* et .*[:,]\s+Cet e-mail vous est envoyé par .* afin de vous informer (?:et de vous confirmer )?qu’une demande d’autorisation de retour a été soumise pour le ou les articles listés ci-dessous",
    "pt": r"Prezados .* e .*[:,]\s+Este e-mail lhe foi enviado pela .* para confirmar que um pedido de autorização para devolução foi emitido para o\(s\) item(?:\(ns\))* abaixo",
    "de": r"Guten Tag,\s+.* sendet Ihnen diese E-Mail zur Bestätigung, dass ein Rücksendeantrag für folgende\(n\) Artikel gestellt wurde",
    "mx": r"Estimados .* y .*[:,]\s+.* os envía este correo electrónico para dejar constancia de la solicitud de autorización presentada para efectuar la devolución de los artículos indicados más adelante",
    "it": r"Gentili .* e .*[:,]\s+questa e-mail vi viene inviata da .* quale notifica e conferma della richiesta di autorizzazione ad effettuare il reso degli articoli elencati di seguito",
    "tr": r"Sayın .* ve .*[:,]\s+Bu not, aşağıdaki ürünler için bir iade onayının istendiğine dair sizi bilgilendirmek ve bunu teyit etmek üzere .* tarafından gönderilmiştir",
    "nl": r"Beste .* en .*[:,]\s+.* stuurt je deze e-mail om te bevestigen dat er autorisatie voor een retourzending is aangevraagd voor de onderstaande items",
    "ja": r"このメールは、出品者様および購入者様の両方にお送りしております。.*よりお知らせいたします。以下の商品について返品が依頼されました。",
    "sv": r"Kära .* och .*[:,]\s+Detta e-postmeddelande skickas till dig av .* för att meddela och bekräfta att ett returtillstånd har begärts för följande artiklar",
}

# fixed values: text that opens the signature of a return notice, and its closing words, by language
RETURN_SIGNATURES = {
    "en": (r"Request received:", "Sincerely,"),
    "fr": (r"(?:Demande reçue:|Requête reçue le\s*:)", "Cordialement,"),
    "pt": (r"Pedido recebido:", "Atenciosamente,"),
    "de": (r"Eingang des Rücksendeantrags:", "Freundliche Grüße"),
    "es": (r"Solicitud recibida el", "Atentamente,"),
    "it": (r"Richiesta ricevuta il:", "Distinti Saluti,"),
    "tr": (r"Alınan talep", "Saygılarımızla"),
    "nl": (r"Verzoek ontvangen:", "Met vriendelijke groet,"),
    "sv": (r"Begäran mottagen:", "Med vänliga hälsningar,"),
    "pl": (r"Żądanie otrzymano:", "Pozdrawiamy,"),
}

# fixed values: opening sentence of a notice that a return was cancelled, by language (regular expressions)
RETURN_CANCEL_NOTICES = {
    "en": r"Dear .* and .*, This note has been sent by .* to inform you and confirm that .* has cancelled the refund request for the following order",
    "fr": r"Chers .* et .*, Cet e-mail vous est envoyé par .* pour vous faire part du fait que .* a annulé sa demande de retour pour la commande suivante",
    "tr": r"Sayın .* ve .*,\s+Bu not, .* adlı alıcının aşağıdaki siparişle ilgili iade talebini iptal ettiğine dair sizi bilgilendirmek ve bunu teyit etmek üzere .* tarafından gönderilmiştir",
}

# fixed values: return signature and message opening of another form: pattern and words it contains
RETURN_SIGNATURE_JA = (r"(?s)返品リクエストの送信日:.*今後とも.*をよろしくお願いいたします。.*", "返品リクエストの送信日:")
SELLER_MESSAGE_JA = (r"(?s)出品者.*からのメッセージ：\s+", "からのメッセージ：")

# fixed values: text that opens a cancelled return, by language
RETURN_CANCELLED = {"en": "Request cancelled:", "fr": "Demande annulée:", "tr": "İptal edilen talep:"}

# fixed values: line that opens a message sent through another program, by language
SELLER_MESSAGE_OPENINGS = {
    "en": "Message from seller",
    "fr": "Message du vendeur",
    "de": "Nachricht vom Verkäufer",
    "pt": "Mensagem do vendedor",
    "es": "Mensaje del vendedor",
    "it": "Messaggio dal venditore",
    "nl": "Bericht van verkoper",
    "pl": "Wiadomość od sprzedawcy",
}

# fixed values: start of a quoted earlier message, by language (regular expression, words it contains)
QUOTATION_STARTS = {
    "en": (
        (r"Did this solve your problem", "Did this solve your problem"),
        (r"Sent from my \w+", "Sent from my "),
        (r"Get Outlook for ", "Get Outlook for "),
        (r"-{2,} *Original Message *-{2,}", "Original Message"),
        (r"-{2,} *Original Email *-{2,}", "Original Email"),
        (r"-{2,} *Message *-{2,}", "Message"),
        (r"On .*(?=wrote:)", "wrote:"),
        (r"_+\s+From: ", "From: "),
        (r"From: ", "From: "),
        (r"Sent: ", "Sent: "),
        (r"-+ *Forwarded message *-+", "Forwarded message"),
    ),
    "de": (
        (r"Von meinem \w+ gesendet-{2,} *Original-Nachricht *-{2,}", "Original-Nachricht"),
        (r"-{2,} *Ursprüngliche Daten *-{2,}", "Ursprüngliche Daten"),
        (r"Am .*(?=schrieb\s*.*:)", "schrieb"),
        (r"-{2,}\s*Originalnachricht", "Originalnachricht"),
    ),
    "fr": (
        (r"Inviato da .*(?=\s)", "Inviato da "),
        (r"-{2,} *Message original en langue anglaise", "Message original en langue anglaise"),
        (r"-{2,} *Finalizar mensaje *-{2,}", "Finalizar mensaje"),
        (r"Le .*(?=wrote\s*:)", "wrote"),
        (r"Le .*(?=a écrit\s*:)", "a écrit"),
    ),
    "es": (
        (r"Enviado desde mi \w+", "Enviado desde mi "),
        (r"El .*(?=escribió\s*:)", "escribió"),
        (r"<\[dirección de correo electrónico eliminada\]>.*(?=escribió\s*:)", "escribió"),
    ),
    "it": (
        (r"-{2,} *Messaggio originale *-{2,}", "Messaggio originale"),
        (r"Il .*(?=ha scritto:)", "ha scritto:"),
    ),
    "pt": (
        (r"Obter o Outlook para .*", "Obter o Outlook para "),
        (r"-{2,} *Iniciar mensagem *-{2,}", "Iniciar mensagem"),
        (r"Em .*(?=escreveu)", "escreveu"),
        (r"-{2,}\s*Atualizado por:\s+", "Atualizado por:"),
    ),
    "tr": (
        (r"Gönderen:.* Gönderildi", " Gönderildi"),
        (r"[^.!?]+\s+cihazımdan gönderildi", "cihazımdan gönderildi"),
        (r"-{2,} *Orijinal mesaj *-{2,}", "Orijinal mesaj"),
        (r"(?<=[\s.?!]) .* tarihinde .*(?=şunu yazdı:)", "şunu yazdı:"),
        (r"-{2,}\s*Gönderen:\s+", "Gönderen:"),
    ),
    "nl": (
        (r"-{2,} *Oorspronkelijk Bericht *-{2,}", "Oorspronkelijk Bericht"),
        (r"Op .*(?=schreef .*:)", "schreef "),
    ),
    "pl": (
        (r"Wysłane z .*'a", "Wysłane z "),
        (r"-{2,} *Ursprüngliche Nachricht *-{2,}", "Ursprüngliche Nachricht"),
        (r"Wiadomość napisana przez .* (?=<\[adres e-mail usunięty\]> w dniu .*:)", "Wiadomość napisana przez "),
        (r"<.*\[adres e-mail usunięty\]>\s+(?=napisał\(a\):)", "napisał(a):"),
    ),
    "sv": (
        (r"skrev .*<\[E-postadress borttagen\]>:", "[E-postadress borttagen]"),
        (r"_+\s+Från:", "Från:"),
    ),
    "any": ((r"\s+>+", ">"), (r"\s+_{2,}", "__")),
}

# fixed values: word in a bracket that marks removed content
REMOVED_WORDS = (
    "removed", "entfernt", "supprimée", "eliminado", "eliminato", "eliminada", "removido", "usunięty",
    "verwijderd", "borttagen",
)

# fixed values: state and territory codes and state names
STATE_CODES = (
    "AL AK AS AZ AR CA CO CT DE DC FM FL GA GU HI ID IL IN IA KS KY LA ME MH MD MA MI MN MS MO MT NE NV NH NJ "
    "NM NY NC ND MP OH OK OR PW PA PR RI SC SD TN TX UT VT VI VA WA WV WI WY"
).split()
STATE_NAMES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida",
    "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine",
    "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska",
    "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio",
    "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas",
    "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)

# fixed values: emoji and symbol ranges that are removed
EMOJI_RANGES = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
    (0x2702, 0x27B0),
    (0x24C2, 0x1F251),
)

# fixed values: words that mark the key lines of a status mail, and the text that identifies one
STATUS_MAIL = "Status do seu pedido"
STATUS_WORDS = (
    "status", "pedido", "entrega", "transportadora", "criado", "despachado", "trânsito", "entregue",
    "data estimada",
)

# fixed values: entities written out in cleaned page text, in order of replacement
HTML_ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&mdash;", "—"), ("&ndash;", "–"),
)
