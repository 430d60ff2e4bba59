"""Column builders for text primitives and array statistics.

All work inside one row: no explode and no shuffle.  Lambdas refer to columns
and their own variables only, since an expression inside a lambda is worked out
again for every element; ``let`` binds one where it is needed.  Distributions are taken
from a sorted array by the lengths of its runs, so a document of n words costs
n log n.  Empty arrays give the documented defaults, never an error.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from re import _constants as R
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


#: What a pattern means by white space.
SPACE = " \t\n\x0b\f\r"


def ws_words(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text, r"\s+"), "")


def flat(text: Column) -> Column:
    """The text with one blank for each run of white space and none at its ends, so that it can be cut at a letter instead of a pattern."""
    return F.trim(F.regexp_replace(text, r"\s(?:\s+|(?<! ))", " "))


def flat_words(c: Column) -> Column:
    """Words of a ``flat`` text or a part of one."""
    return F.array_remove(F.split(c, " "), "")


def alpha_words(text: Column) -> Column:
    """Lower-case runs of a-z that are not part of a longer word of letters, digits or underscores."""
    return alpha_of(F.lower(text))


def alpha_of(low: Column) -> Column:
    """``alpha_words`` of a text that is lower-case already."""
    return F.array_remove(F.regexp_extract_all(low, F.lit(r"([a-z]++)(?![\w\p{L}\p{N}])|[\w\p{L}\p{N}]++"), F.lit(1)), "")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def pieces(text: Column, pattern: str) -> Column:
    """Parts between matches of ``pattern`` that are not blank, stripped."""
    return F.array_remove(F.transform(F.split(text, pattern), strip), "")


def sentences(text: Column) -> Column:
    return pieces(text, r"[.!?]+")


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a substring that do not overlap; texts without one are only looked through."""
    # by bytes, which a string knows without counting
    found = ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part)))) / len(part.encode())).cast("long")
    return F.when(~text.contains(part), F.lit(0).cast("long")).otherwise(found)


def _group_end(p: str) -> int:
    """Where the group closes that ``p`` opens with."""
    depth, i = 0, 0
    while i < len(p):
        depth += {"(": 1, ")": -1}.get(p[i], 0)
        if depth == 0:
            return i
        i += 2 if p[i] == "\\" else 1
    return -1


def _firsts(p: str) -> set[str] | None:
    """Small letters that a match of ``p`` may begin with; None where that is not plain to see."""
    if p[:1] == "(":
        end = _group_end(p)
        inner, rest = p[1:end].removeprefix("?:"), p[end + 1 :]
        if end < 0 or inner[:1] == "?" or "[" in inner and re.search(r"\[[^\]]*[()|]", inner) or rest[:1] in ("*", "{"):
            return None
        parts, depth, at = [], 0, 0
        for i, c in enumerate(inner):
            depth += {"(": 1, ")": -1}.get(c, 0)
            if c == "|" and depth == 0:
                parts, at = [*parts, inner[at:i]], i + 1
        found = [*map(_firsts, [*parts, inner[at:]]), *([_firsts(rest[1:])] if rest[:1] == "?" else [])]
        return None if None in found else set().union(*found)
    return {p[0]} if re.match(r"[a-z](?![?*{|])", p) else None


def led(pattern: str) -> str:
    """``pattern`` behind a look at the next letter, where it is a word boundary and a group: the same matches, most places given up at once."""
    if not pattern.startswith(r"\b(") or "\\" in (group := pattern[2:])[: _group_end(group)] or "|" in group[_group_end(group) :]:
        return pattern
    found = _firsts(group)
    return f"(?=[{''.join(sorted(found))}]){pattern}" if found else pattern


#: What a pattern leaves open, in the texts of ``_texts``; a pattern with more texts than the second has no cues.
_OPEN, _MOST_TEXTS = "\0", 4096


def _texts(parsed) -> list[str]:
    """Every text that a parsed pattern describes: open places as ``_OPEN``, word boundaries as line ends."""
    out = [""]
    for op, arg in parsed:
        if op is R.LITERAL:
            found = [chr(arg)]
        elif op is R.IN and len(arg) <= 4 and all(o is R.LITERAL for o, _ in arg):
            found = [chr(a) for _, a in arg]
        elif op is R.IN and arg == [(R.CATEGORY, R.CATEGORY_SPACE)]:
            found = [" "]
        elif op is R.AT and arg is R.AT_BOUNDARY:
            found = ["\n"]
        elif op is R.BRANCH:
            found = [t for part in arg[1] for t in _texts(part)]
        elif op is R.SUBPATTERN:
            found = _texts(arg[-1])
        elif op is R.MAX_REPEAT:
            least, most, part = arg
            once = _texts(part)
            found = [x for n in range(least, most + 1) for x in map("".join, product(once, repeat=n))] if most <= 2 else ["".join(x) + _OPEN for x in product(once, repeat=least)]
        else:
            found = [_OPEN]
        out = list(dict.fromkeys(a + b for a in out for b in found))
        if len(out) > _MOST_TEXTS:
            return [_OPEN]
    return out


def cues(pattern: str) -> tuple[set[str], set[str]]:
    """Words, and other parts of a text, one of which stands wherever a small-letter pattern matches; both empty where that is not plain to see."""
    words, parts = set(), set()
    for t in _texts(_parser.parse(pattern)):
        whole = re.findall(rf"(?<![\w{_OPEN}])[a-z]+(?![\w{_OPEN}])", f"{_OPEN}{t}{_OPEN}")
        fixed = max(re.split(rf"[{_OPEN}\n]", t), key=len)
        if whole:
            words.add(max(reversed(whole), key=len))
        elif len(fixed) > 1:
            parts.add(fixed)
        else:
            return set(), set()
    return words, parts


def cue_words(patterns: list[str]) -> set[str]:
    return set().union(*(cues(p)[0] for p in patterns))


def matches(text: Column, patterns: list[str], found: Column | None = None) -> Column:
    """Matches of all patterns; given ``found``, the cues among the text's words, a pattern is only looked for where it has one."""

    def count(p: str) -> Column:
        hits = F.regexp_count(text, F.lit(led(p)))
        if found is None:
            return hits
        words, parts = cues(p)
        if not words | parts:
            core = re.fullmatch(r"\\b\\w\*(.+)\\w\*\\b", p)
            return F.when(text.rlike(core[1]), hits).otherwise(0) if core else hits
        there = [F.array_contains(found, w) for w in sorted(words)] + [F.contains(text, F.lit(x)) for x in sorted(parts)]
        return F.when(reduce(lambda a, b: a | b, there), hits).otherwise(0)

    return total([count(p) for p in patterns])


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def among(words: Column, wanted: list[str]) -> Column:
    """How many of ``words`` are in ``wanted``."""
    return F.size(F.filter(words, lambda x: x.isin(sorted(set(wanted)))))


def phrase_count(low: Column, word_runs: Column, phrases: list[str]) -> Column:
    """Phrases of several words as substrings, single words among the word runs."""
    return total([count_of(low, p) for p in phrases if " " in p]) + among(word_runs, [p for p in phrases if " " not in p])


def word_runs(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


# -- numbers ------------------------------------------------------------------


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column, default: float = 0.0) -> Column:
    return let(a, lambda x: F.when(F.size(x) > 0, sum_of(x) / F.size(x)).when(x.isNotNull(), F.lit(default)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it, also from inner lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _moments(a: Column, finish) -> Column:
    """``finish`` of count, sum and sum of squares of an array; two passes that each carry a number are faster than one that builds a struct for each element."""
    parts = lambda x: F.struct(F.size(x).cast("double").alias("n"), sum_of(x).alias("s"), F.aggregate(x, F.lit(0.0), lambda q, v: q + v * v.cast("double")).alias("q"))
    return let(a, lambda x: F.when(x.isNotNull(), let(parts(x), finish)))


def _var(m: Column, sample: bool) -> Column:
    return F.greatest(m["q"] - m["s"] * m["s"] / m["n"], F.lit(0.0)) / (m["n"] - int(sample))


def var_of(a: Column, sample: bool = False) -> Column:
    """Variance; 0 below two values."""
    return _moments(a, lambda m: F.when(m["n"] > 1, _var(m, sample)).otherwise(F.lit(0.0)))


def std_of(a: Column, sample: bool = False) -> Column:
    """Standard deviation; 0 below two values."""
    return _moments(a, lambda m: F.when(m["n"] > 1, F.sqrt(_var(m, sample))).otherwise(F.lit(0.0)))


def cv_of(a: Column, sample: bool = False) -> Column:
    """Standard deviation over mean; 0 below two values or for a mean of 0."""
    return _moments(a, lambda m: F.when((m["n"] > 1) & (m["s"] != 0), F.sqrt(_var(m, sample)) / (m["s"] / m["n"])).otherwise(F.lit(0.0)))


def autocorr(a: Column, plain: bool = False) -> Column:
    """Lag-1 autocorrelation, 0 without variance or below three values.

    Covariance over n - 1 and variance over n, or both sums if ``plain``.
    """
    start = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "s", "q", "cross", "first", "last")))

    def step(m: Column, x: Column) -> Column:
        x = x.cast("double")
        return F.struct((m["n"] + 1).alias("n"), (m["s"] + x).alias("s"), (m["q"] + x * x).alias("q"), (m["cross"] + F.when(m["n"] > 0, m["last"] * x).otherwise(0.0)).alias("cross"), F.when(m["n"] > 0, m["first"]).otherwise(x).alias("first"), x.alias("last"))

    def finish(m: Column) -> Column:
        mean, var = m["s"] / m["n"], m["q"] - m["s"] * m["s"] / m["n"]
        cov = m["cross"] - mean * (2 * m["s"] - m["first"] - m["last"]) + (m["n"] - 1) * mean * mean
        return F.when((m["n"] > 2) & (var > 1e-9), cov / var if plain else (cov / (m["n"] - 1)) / (var / m["n"])).otherwise(F.lit(0.0))

    return F.aggregate(a, start, step, finish)


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y on x, 0 without spread in x."""
    start = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")))
    points = F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    step = lambda m, p: F.struct((m["n"] + 1).alias("n"), (m["x"] + p["a"]).alias("x"), (m["y"] + p["b"]).alias("y"), (m["xx"] + p["a"] * p["a"]).alias("xx"), (m["xy"] + p["a"] * p["b"]).alias("xy"))
    finish = lambda m: F.when((m["n"] > 1) & (m["n"] * m["xx"] > m["x"] * m["x"]), (m["n"] * m["xy"] - m["x"] * m["y"]) / (m["n"] * m["xx"] - m["x"] * m["x"])).otherwise(F.lit(0.0))
    return F.aggregate(points, start, step, finish)


def ngrams(words: Column, n: int) -> Column:
    """Neighbouring words joined by a space."""
    last = F.size(words) - n
    at = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<string>"))


def ngram_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of every n neighbouring words: counts need no strings to be built or compared."""
    last = F.size(words) - n
    at = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))


def hashes(words: Column) -> Column:
    """A 64-bit hash of every word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(ordered: Column) -> Column:
    """Lengths of the runs of equal elements of a sorted array, which must be a column, not an expression."""
    ends = F.filter(F.transform(ordered, lambda x, i: F.when(~x.eqNullSafe(F.get(ordered, i + 1)), i)), lambda i: i.isNotNull())
    # bound, since each mention would look for the ends again
    return let(ends, lambda e: F.transform(e, lambda end, k: F.when(k > 0, end - F.get(e, k - 1)).otherwise(end + 1)))


def with_counts(df: DataFrame, **arrays: Column) -> DataFrame:
    """For each name, a column ``<name>`` with how often each distinct element of the array occurs."""
    df = df.withColumns({f"_sorted_{k}": F.sort_array(a) for k, a in arrays.items()})
    return df.withColumns({k: runs(F.col(f"_sorted_{k}")) for k in arrays}).drop(*(f"_sorted_{k}" for k in arrays))


def entropy(counts: Column) -> Column:
    """Bits of entropy of a distribution given by counts; 0 for none."""
    n = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    terms = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double")))
    return F.when(F.size(counts) > 1, F.log2(n) - terms / n).otherwise(F.lit(0.0))


def entropy_share(counts: Column) -> Column:
    """Entropy over its maximum for as many distinct elements; 0 for one or none."""
    return F.when(F.size(counts) > 1, entropy(counts) / F.log2(F.size(counts).cast("double"))).otherwise(F.lit(0.0))


def zero_unless(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0.0))
