"""Text intelligence as column expressions: patterns, strings, entropy, fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules

#: Rows of a rule table that become constant expressions.
CONSTANT_RULES = 200


def matches(text: Column, kind: str) -> Column:
    """All matches of a named pattern."""
    return F.regexp_extract_all(text, F.lit(rules.java_bounds(rules.PATTERNS[kind])), F.lit(0))


def hits(text: Column, kind: str) -> Column:
    return text.rlike(rules.java_bounds(rules.PATTERNS[kind]))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def printable_runs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pos, run``: printable ASCII runs of seven or more characters, in order."""
    return df.select(*keys, F.posexplode(matches(F.col(text), "printable")).alias("pos", "run"))


def intelligence(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, kind, n, n_distinct``: matches of urls, emails, addresses and uuids, where there are any."""
    kinds = ("url", "email", "ip", "uuid")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), matches(F.col(text), k).alias("m")) for k in kinds])
    rows = df.select(*keys, F.explode(found).alias("f")).filter(F.size("f.m") > 0)
    return rows.select(*keys, "f.kind", F.size("f.m").cast("long").alias("n"), F.size(F.array_distinct("f.m")).cast("long").alias("n_distinct"))


def rule_hits(df: DataFrame, keys: list[str], text: str, dimension: DataFrame, samples: int = 5) -> DataFrame:
    """``keys, code, severity, n, samples``: fingerprint rules that a text matches, whole matches as samples.

    The dimension holds a few dozen rows by design, which become constant expressions: a
    text stays one row and each pattern is compiled once.  A larger one is joined.
    """
    few = dimension.select("code", "severity", "java").limit(CONSTANT_RULES + 1).collect()
    if len(few) <= CONSTANT_RULES:
        each = [F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.regexp_extract_all(F.col(text), F.lit(r.java), F.lit(0)).alias("all")) for r in few]
        if not each:
            each = [F.struct(F.lit("").alias("code"), F.lit("").alias("severity"), F.array().cast("array<string>").alias("all"))]
        found = df.select(*keys, F.explode(F.array(*each)).alias("f")).filter(F.size("f.all") > 0).select(*keys, "f.*")
    else:
        met = df.select(*keys, text).join(dimension, F.regexp_like(F.col(text), F.col("java")))
        found = met.select(*keys, "code", "severity", F.regexp_extract_all(F.col(text), F.col("java"), F.lit(0)).alias("all"))
    return found.select(*keys, "code", "severity", F.size("all").cast("long").alias("n"), F.slice("all", 1, samples).alias("samples"))


def is_hex_like(value: Column) -> Column:
    """24 or more characters, all hexadecimal, more than eight of them distinct (case aside)."""
    letters = F.array_distinct(F.split(F.lower(value), ""))
    return (F.length(value) >= 24) & value.rlike(rules.PATTERNS["hex"]) & (F.size(F.filter(letters, lambda c: c != "")) > 8)


def is_base64_like(value: Column) -> Column:
    """32 or more characters of the base64 alphabets with at least one mark, and not hex-like."""
    return ~is_hex_like(value) & (F.length(value) >= 32) & value.rlike(rules.PATTERNS["base64"]) & value.rlike(r"[+/=_\-]")


def is_interesting(value: Column) -> Column:
    found = F.lit(False)
    for pattern, further in rules.INTERESTING:
        met = value.rlike(pattern)
        for also in further:
            met = met & value.rlike(also)
        found = found | met
    return (F.length(value) >= 7) & found


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def char_entropy(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, entropy``: Shannon entropy in bits of a text's characters, one row a text; null and empty texts give no row.

    Characters are counted where the text is, without a shuffle.
    """

    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1].astype(float)
            out.append(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())
        return pd.Series(out, dtype="float64")

    return df.filter(F.length(text) > 0).select(*keys, entropy(text).alias("entropy"))


def hashes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return df.select(*keys, F.md5(value).alias("md5"), F.sha1(value).alias("sha1"), F.sha2(value, 256).alias("sha256"))


def named_by_hash(stem: Column, md5: Column, sha1: Column, sha256: Column) -> Column:
    """A name that gives its content's hash away: a whole digest, or eight or more first digits of the MD5."""
    name = F.lower(stem)
    partial = (F.length(name) >= 8) & name.rlike("^[0-9a-f]+$") & F.startswith(md5, name)
    return (name == md5) | (name == sha1) | (name == sha256) | partial | F.startswith(name, md5)
