"""Small tables with everything that operators must bear."""

import os
import random
import tempfile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside or put out.
EXTRA = ", kept string, component_id string, sketch string, sequence_id string, score string, n string, rank string, _rows string"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    long = words(1, 30_000)
    return [
        None, "", " \n\t ", "a", "one two", "one two", "!!! ...", "x" * 5000, "=" * 3000 + " " * 900,
        long, long, words(2, 300), words(2, 300), words(2, 300).upper(), words(3, 300), words(2, 300) + " end",
        "naïve café — 漢字かな 😀 don't we'll  I'm", "<|endoftext|> <|im_start|>x<|im_end|> <\\| <\\\\|",
        "mail a.b@example.com, +1 (434) 555-9575, 48.54.59.82", "  　\x1c\x85 odd spaces",
    ]


def documents(spark, extra=False):
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows."""
    rows = [(i, t, ("en", "de", None)[i % 3], "s" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[11], rows[11], (None, "no id here at all", "en", None, 17), (None, None, None, None, None)]
    if extra:
        return spark.createDataFrame([(*r, *["e"] * 8) for r in rows], DOCS + EXTRA)
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def sf_dir(spark, **tables):
    """A data folder with these tables."""
    top = tempfile.mkdtemp(prefix="playlens-sf-", dir="/tmp")
    for name, df in tables.items():
        df.write.parquet(os.path.join(top, f"{name}.parquet"))
    return top
