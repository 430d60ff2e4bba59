"""Awkward inputs that every operator over documents is tried on."""

import datetime
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, fp string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = words(30_000, 1)
    rows = [(0, words(60, 2)), (1, words(60, 2)), (1, words(60, 2)), (2, None), (3, ""), (4, "  \n "), (5, long), (6, long + " end"), (7, "Ünï  \n \n çødé   x"), (8, "one"), (9, "one")]
    rows += [(20 + i, "copy of one text again and again") for i in range(40)]
    rows += [(100 + i, words(5 + i, i)) for i in range(60)]
    rows += list(extra)
    full = [(i, t, "en", "src0", len(t or ""), "k", "s", "f") for i, t in rows]
    return spark.createDataFrame([*full, (10, "nulls elsewhere", None, None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Identifiers that doubles cannot tell apart, beside a null.
WIDE = [2**53, 2**53 + 1, None, -(2**63), 2**63 - 1]
WIDE_SCHEMA = "doc_id long, text string, lang string, stamp timestamp, nested struct<a: array<long>, b: map<string, long>>"


def wide(spark, texts):
    """Documents with ``WIDE`` identifiers, a time stamp and nested wide numbers."""
    rows = [(WIDE[i % 5], t, "en", datetime.datetime(2024, 1, 1, 0, 0, i), ([2**53 + 1, None], {"k": 2**53 + i})) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, WIDE_SCHEMA)


#: Names that operators might use for columns of their own.
OWN = ["_id", "_kept", "_node", "_row", "_toxic", "_fold", "_k", "_heavy", "_rows", "_NODE", "id", "node", "row", "fp", "bands", "bytes", "domain", "words", "rate", "block", "learn", "h", "n", "g", "lang_", "hash", "at"]


def with_own_names(docs):
    """``docs`` with a column of each of ``OWN`` that tells rows apart."""
    kept = docs.select("doc_id", "text", "lang")
    names = [n for i, n in enumerate(OWN) if n.lower() not in {m.lower() for m in OWN[:i]}]
    return kept.selectExpr("*", *(f"concat('{n}', cast(doc_id as string)) as `{n}`" for n in names))
