import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """Rows of documents; ``texts`` are texts or (doc_id, text) pairs, other columns by position."""
    pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    source, lang = columns.get("source", ["s"] * len(pairs)), columns.get("lang", ["en"] * len(pairs))
    rows = [(i, t, lang[k], source[k], len(t or "")) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df, *names):
    """``df`` with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
