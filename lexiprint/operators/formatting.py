"""How texts of a domain are laid out, and who a sample says wrote it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T

# Beginnings of articles that carry their headline, marks of code, and words and columns that tell an author.
HEADED = ["# ", "Supported by\n"]
CODE = ["def ", "function ", "class ", "import ", "#include"]
LONGEST_TITLE, CODE_WITHIN = 200, 100
FLAGS = ["is_human", "is_original", "human_written"]
SAID = ["source", "label", "type"]
MACHINE = ["ai", "gpt", "generated", "machine"]
MODEL = ["model", "generated_by", "model_name"]


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def news(text: Column, title: Column, url: Column) -> Column:
    """Headline, source and text; without a title the text's own first line serves if it is marked as one."""
    head = F.substring_index(text, "\n", 1)
    own = T.strip(F.btrim(head, F.lit("# ")))
    starts = F.startswith(text, F.lit(HEADED[0])) | F.startswith(text, F.lit(HEADED[1]))
    taken = ~_given(title) & starts & (F.length(own) < LONGEST_TITLE)
    name = F.when(_given(title), title).when(taken, own)
    rest = F.when(taken, T.strip(F.substring(text, F.length(head) + 2, F.length(text)))).otherwise(text)
    return F.concat_ws("\n", F.when(_given(name), F.concat(F.lit("# "), name, F.lit("\n"))), F.when(_given(url), F.concat(F.lit("*Source: "), url, F.lit("*\n"))), rest)


def legal(text: Column, case_name: Column, court: Column, date: Column) -> Column:
    """The document behind its case, court and date, as far as they are given."""
    line = lambda label, c: F.when(_given(c), F.concat(F.lit(f"**{label}:** "), c))
    any_line = _given(case_name) | _given(court) | _given(date)
    return F.concat_ws("\n", line("Case", case_name), line("Court", court), line("Date", date), F.when(any_line, F.lit("\n---\n")), text)


def formatted(text: Column, domain: Column, subdomain: Column, title: Column, url: Column, case_name: Column, court: Column, date: Column) -> Column:
    """``text`` as somebody would paste it, by domain; null texts are empty and other domains plain."""
    body = F.coalesce(text, F.lit(""))
    bare, start = T.strip(body), F.lower(F.substring(body, 1, CODE_WITHIN))
    code = F.lit(False)
    for mark in CODE:
        code = code | F.contains(start, F.lit(mark))
    essay = F.concat_ws("\n", F.when(_given(title), F.concat(title, F.lit("\n"))), body)
    return (
        F.when(domain == "journalistic", news(body, title, url))
        .when((domain == "academic") & F.coalesce(subdomain == "essays", F.lit(False)), essay)
        .when((domain == "technical") & code, F.concat(F.lit("```python\n"), body, F.lit("\n```")))
        .when(domain == "legal", legal(body, case_name, court, date))
        .otherwise(bare)
    )


def written_by_human(samples: DataFrame) -> Column:
    """Whether a row says that a human wrote it, by the first of the known columns that says something; else yes.

    Flags come first, then columns that name a source, then columns that name
    a model.  A null says nothing.
    """
    known = [c for c in samples.columns]
    out = F.when(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in MODEL if c in known), F.lit(None)).isNotNull(), False).otherwise(True)
    for c in reversed([c for c in SAID if c in known]):
        value = F.lower(F.col(c).cast("string"))
        machine = F.lit(False)
        for word in MACHINE:
            machine = machine | F.contains(value, F.lit(word))
        out = F.when(F.contains(value, F.lit("human")), True).when(machine, False).otherwise(out)
    for c in reversed([c for c in FLAGS if c in known]):
        out = F.when(F.col(c).isNotNull(), F.col(c).cast("boolean")).otherwise(out)
    return out
