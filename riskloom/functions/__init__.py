"""Column functions: text, dialogue, labelling responses, prediction formats."""
