"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

from sparkwarden.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, size long, kept boolean, component_id long"
PASSAGE = "a passage of words that several texts share, long enough to count as one: " * 2
PLAIN = "Some words make a line that reads like prose.\nAnother line follows it, and then one more.\nThe last line ends here, at ease."


def rows() -> list[tuple]:
    texts = [
        (0, PLAIN, "en", "b"), (1, PLAIN, "en", "b"), (2, PLAIN + " Again.", "en", "a"), (3, None, None, "a"), (4, "", "en", None), (5, " \n\t ", "fr", None),
        (6, PASSAGE + "one end", "en", "a"), (7, "another start " + PASSAGE, "en", "a"), (8, "&&& ### $$$ " * 40, "en", "c"), (9, "long " * 30_000, "en", "c"),
        (10, "Été à l'école, où ça va très bien.\n" * 3, "fr", "c"), (11, "x", "en", "a"), (12, "é" * 300, "fr", "b"), (13, "SHOUTS!! " * 60, "en", "b"),
        (14, "12345 67890", None, "a"), (15, "Москва и другие города", "ru", "a"), (16, "ab" * 400, "en", "a"),
        (None, PLAIN, "en", "b"), (None, "no number here, but a text", None, None), (7, "another start " + PASSAGE, "en", "a"), (7, "a different text with the same number", "en", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), 1, 5, None, -1) for i, t, lang, source in texts]


def documents(spark, data: list[tuple] | None = None):
    """The table, stored in several files so that tasks see parts of it."""
    return stored(spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3), "cases")
