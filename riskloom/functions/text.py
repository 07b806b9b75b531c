"""Text cleaning as Column expressions; each works on one string."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from riskloom.functions import fixed_values as fv

# any Unicode white space, spelled so that every regex dialect agrees
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def text_normalize(c: Column) -> Column:
    return F.lower(squeeze(c))


def text_upper(c: Column) -> Column:
    return F.upper(squeeze(c))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def each(fn):
    """Apply a string function to every message of an array."""
    return lambda c: F.transform(c, fn)


EMOJI = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in fv.EMOJI_RANGES) + "]+"


def emoji_remove(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


class _TextNodes(HTMLParser):
    """Collects stripped text nodes outside script, style and template."""

    hidden = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.parts: list[str] = []
        self.depth = 0

    def flush(self):
        text = "".join(self.parts).strip()
        self.parts = []
        if text:
            self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.depth += tag in self.hidden

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.hidden and self.depth:
            self.depth -= 1

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _node_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser.flush()
    return " ".join(parser.nodes)


@pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Text nodes, stripped and joined by one space. Catalyst has no HTML parser."""
    return html.map(_node_text, na_action="ignore")


# rule, replacement; in order
HTML_RULES = (
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?p[^>]*>", "\n"),
    (r"(?i)</?div[^>]*>", "\n"),
    (r"(?i)</tr>", "\n"),
    (r"(?i)</td>", " | "),
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"<[^>]+>", ""),
    (r"\n\s*\n+", "\n\n"),
    (r"[ \t]+", " "),
    (r" \| \| ", " | "),
    (r"(?m)^\s*\|\s*", ""),
    (r"(?m)\s*\|\s*$", ""),
)


def html_clean_rules(c: Column) -> Column:
    """Mail or page markup to lines of text. Text without a known tag is returned as it is."""
    has_tag = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t)) for t in ("<html>", "<div>", "<span>", "<table>")])
    out = c
    for pattern, repl in HTML_RULES:
        # only \n ends a line
        out = F.regexp_replace(out, pattern.replace("(?m)", "(?md)"), repl)
    for entity, char in fv.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = strip(F.regexp_replace(out, r"https?://\S{50,}", "[URL]"))
    return F.when(has_tag, let(out, status_mail_lines)).otherwise(c)


def status_mail_lines(c: Column) -> Column:
    """A long status mail is cut to its first ten key lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    key = "|".join(fv.STATUS_WORDS)
    kept = F.filter(lines, lambda x: F.lower(x).rlike(key))
    is_mail = (F.length(c) > 1000) & F.contains(c, F.lit(fv.STATUS_MAIL)) & (F.size(kept) > 0)
    return F.when(is_mail, F.array_join(F.slice(kept, 1, 10), "\n")).otherwise(c)


# cleaning rules, in order; the first group needs no look-around
PLAIN_RULES = (
    (r"&nbsp;|&lt;|&gt;|&amp;", " "),
    (r"[-=]{2,}[\w\-*$\s:]+[-=]{2,}", " "),
    (r"<.*>|\[.*\]|\(.*\)", ""),
    (r"\s\s+", " "),
    (r"^\s+", ""),
    (r"[\s>_]+\z", ""),
)
LOOKAROUND_RULES = (
    (r"([.,!?:;])\1+", "$1"),
    (r"(?<=\S)\s+(?=[.,!?:;])", ""),
    (r"(?<=[,.])\s+(?=[,.])", ""),
    (r"(?<=[.,!?:;])(?=\S)", " "),
    (r"[.!?,:;_\s]+(?=[.!?])", ""),
    (r"(?<=[^.!?])\z", "."),
)


def apply_rules(c: Column, rules) -> Column:
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), rules, c)


def text_regex_rules(c: Column) -> Column:
    return apply_rules(apply_rules(c, PLAIN_RULES), LOOKAROUND_RULES)


def plain_rules(c: Column) -> Column:
    return apply_rules(c, PLAIN_RULES)


def sentence_split(c: Column) -> Column:
    """Sentences: a lower-case letter or digit, an end mark, white space, then a capital."""
    return F.split(c, r'(?:(?<=[a-z0-9][.?!])|(?<=[a-z0-9][.?!]"))(?:\r\n|\s)(?="?[A-Z])')


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def _phrases(table: dict) -> str:
    phrases = {p for ps in table.values() for p in ps}
    # longest first, so that a phrase wins over its own beginning
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    return "|".join(p.replace(".", r"\.") for p in ordered)


GREETING_LINE = rf"(?im)^[ \t]*(?:{_phrases(fv.GREETINGS)})(?:[ \t,:!.]|$)[^\n,:!.]*[,:!.]?"
FAREWELL_LINE = rf"(?im)^[ \t]*(?:{_phrases(fv.FAREWELLS)})(?:[ \t,:!.]|$)[^\n]*"


def greeting_farewell_strip(c: Column) -> Column:
    """Remove opening phrases (to the next mark) and closing lines, in ten languages."""
    # case of every script, and only \n ends a line
    opening, closing = (p.replace("(?im)", "(?imud)") for p in (GREETING_LINE, FAREWELL_LINE))
    return strip(F.regexp_replace(F.regexp_replace(c, opening, ""), closing, ""))


def informative_tokens(c: Column) -> Column:
    """Tokens that are not in the list of empty words."""
    empty = F.array(*[F.lit(t) for t in fv.NONINFORMATIVE_TOKENS])
    return F.filter(tokens(c), lambda t: ~F.array_contains(empty, F.lower(t)))


def template_patterns(brand: str) -> dict[str, list[tuple[str, str, str]]]:
    """Per kind of service-mail part: ``(language, pattern, words it needs)``; ``brand`` signs return notices."""
    reason = fv.RETURN_REASON_MARKERS
    return {
        "header": [(lang, rf"(?is){start}.*(?={end})", end) for lang, (start, end) in fv.SERVICE_HEADERS.items()],
        "signature": [
            (lang, rf"(?is){_literal(start)}.* {close}.*", start)
            for lang, (start, close) in fv.SERVICE_SIGNATURES.items()
        ],
        "return notice": [
            (lang, rf"(?s){start}.*(?={reason[lang]}\s*)", reason[lang]) for lang, start in fv.RETURN_NOTICES.items()
        ],
        "return signature": [
            (lang, rf"(?s){start}.* {close}\s+{brand}.*", close)
            for lang, (start, close) in fv.RETURN_SIGNATURES.items()
        ]
        + [("ja", *fv.RETURN_SIGNATURE_JA)],
        "cancel notice": [
            # the words after the last open span
            (lang, rf"(?s){start}.*(?={reason[lang]}\s*)", start.split(".* ")[-1])
            for lang, start in fv.RETURN_CANCEL_NOTICES.items()
        ],
        "cancelled return": [(lang, rf"(?s){start}.*", start) for lang, start in fv.RETURN_CANCELLED.items()],
        "seller message": [
            (lang, rf"{start} [\w\-\s]+:\s+(?=\w)", start) for lang, start in fv.SELLER_MESSAGE_OPENINGS.items()
        ]
        + [("ja", *fv.SELLER_MESSAGE_JA)],
    }


def _literal(s: str) -> str:
    return s.replace(".", r"\.").replace("?", r"\?")


def template_strip(c: Column, lang: Column, brand: str) -> Column:
    """Remove the templates of the row's language: one replacement per kind of part.

    A pattern with several open spans is slow on a long text that does not match, so
    it is used only on texts that contain its fixed words.
    """
    lowered = F.lower(c)
    out = c
    for rules in template_patterns(brand).values():
        pattern = F.when(F.lit(False), "")
        for name, regex, words in rules:
            pattern = pattern.when((lang == name) & F.contains(lowered, F.lit(words.lower())), regex)
        out = F.regexp_replace(out, pattern.otherwise("(?!)"), F.lit(""))
    return out


REMOVED_PART = rf"(?s)\[.*(?:{'|'.join(fv.REMOVED_WORDS)})\]"


def quotation_cut(c: Column) -> Column:
    """Text before the first quoted earlier message.

    Each start is looked for only in texts that contain its fixed words, as some of
    the patterns scan to the end of the text from many places.
    """

    def cut(t: Column) -> Column:
        starts = [
            F.nullif(F.when(F.contains(t, F.lit(words)), F.regexp_instr(t, F.lit(f"(?s){pattern}"))), F.lit(0))
            for rules in fv.QUOTATION_STARTS.values()
            for pattern, words in rules
        ]
        return F.coalesce(F.substring(t, F.lit(1), F.least(*starts) - 1), t)

    return let(c, cut)


def removed_part_strip(c: Column) -> Column:
    return F.regexp_replace(c, REMOVED_PART, "")
