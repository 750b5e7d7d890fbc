"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which characters may follow one another within a unit. It becomes one zero-width boundary regex over neighbouring
classes: a boundary lies behind a character of some class and before any that may not follow it. Spark's split() at that regex keeps
every character, so the pieces are the units; the empty text, which split() makes one empty piece of, has none.

Two cuts between units, taken from a keyed hash of the document's id, part a text into prefix, middle and suffix, which are written with
the three marks in one of two orders. A text that is empty, or that holds a mark, or whose hash says so, stays as it is. Marks have no
common border and no text that is cut holds one, so the parts are what stands between them: restore() rebuilds the text.

Everything is DataFrame functions: one narrow step, no shuffle, whatever the table's size or skew.

Cases: a null text is the empty one; a null id is hashed as the empty string; equal ids are cut at equal shares of their own texts; repeated
rows give a row each; an empty table gives no rows; other columns are ignored by fill_in_middle() and kept by transformed(); a text of any length
is split whole; characters outside the basic plane are one unit each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import id_text, quoted, spare

ANY = r"[\s\S]"


@dataclass(frozen=True)
class Grammar:
    """`classes`: name → inside of a character class of Java; together they hold each character once. `joins`: (a, b) if a character of
    class b, right after one of class a, belongs to the same unit."""

    classes: tuple[tuple[str, str], ...]
    joins: tuple[tuple[str, str], ...] = ()

    @property
    def boundary(self) -> str:
        inside, ways = dict(self.classes), []
        for name, letters in self.classes:
            joined = "|".join(f"[{inside[b]}]" for a, b in self.joins if a == name)
            ways.append(f"(?<=[{letters}])" + (f"(?!{joined})" if joined else "") + f"(?={ANY})")
        return "|".join(ways)


_WORDS = (("letter", "A-Za-z"), ("other", "^A-Za-z"))
#: A run of ASCII letters, or one other character.
TOKENS = Grammar(_WORDS, (("letter", "letter"),))
#: Each character.
CHARACTERS = Grammar((("all", r"\s\S"),))
#: A line with its line feed.
LINES = Grammar((("text", "^\n"), ("feed", "\n")), (("text", "text"), ("text", "feed")))
#: A word with the blanks before it; blanks at the end are a unit.
SPACED = Grammar((("word", r"^\x20\x09-\x0D"), ("blank", r"\x20\x09-\x0D")), (("word", "word"), ("blank", "blank"), ("blank", "word")))


def units(text: Column, grammar: Grammar = TOKENS) -> Column:
    """The units of a text, in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


@dataclass(frozen=True)
class Form:
    """Marks and shares of the output; shares are of 100. `seed` keys the hash."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_share: int = 90
    spm_share: int = 20
    seed: str = "1"

    def __post_init__(self):
        within = any(a in b for a, b in permutations(self.marks, 2))
        # what begins a mark must not end one, so a mark beside text is found only where it was put
        over = any(b.startswith(a[i:]) for a in self.marks for b in self.marks for i in range(1, len(a)))
        if not all(self.marks) or within or over:
            raise ValueError("marks must not be empty, hold one another or overlap")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _number(n: int) -> Column:
    """The n-th eight digits of the digest."""
    return F.conv(F.substring("digest", 8 * n - 7, 8), 16, 10).cast("long")


def _joined(start: Column, end: Column) -> Column:
    return F.array_join(F.slice("pieces", start + 1, end - start), "")


def fill_in_middle(docs: DataFrame, grammar: Grammar = TOKENS, form: Form = Form()) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output."""
    return _parted(id_text(docs), grammar, form)


def _parted(rows: DataFrame, grammar: Grammar, form: Form, *more: str) -> DataFrame:
    """rows(doc_id, text, and `more`) with what fill_in_middle() adds. Each step reads the pieces that the one before made once."""
    digest = F.sha2(F.concat(F.lit(f"{form.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = reduce(or_, (F.contains("text", F.lit(x)) for x in form.marks))
    cut = rows.select("doc_id", "text", *more, units(F.col("text"), grammar).alias("pieces"), digest.alias("digest"), marked.alias("marked"))
    first, second = (F.pmod(_number(i), F.size("pieces") + 1).cast("int") for i in (1, 2))
    plain = (F.col("text") == "") | F.col("marked") | (_number(3) % 100 >= form.cut_share)
    how = F.when(plain, "plain").when(_number(4) % 100 < form.spm_share, "spm").otherwise("psm")
    placed = cut.select("doc_id", "text", *more, "pieces", F.least(first, second).alias("low"), F.greatest(first, second).alias("high"), how.alias("form"))
    n = F.size("pieces")
    parts = {"prefix": (F.lit(0), F.col("low")), "middle": (F.col("low"), F.col("high")), "suffix": (F.col("high"), n)}
    parted = placed.select("doc_id", "text", *more, n.cast("long").alias("n"), "form", *(F.when(F.col("form") != "plain", _joined(*at)).alias(x) for x, at in parts.items()))
    p, s, m = map(F.lit, form.marks)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return parted.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form_name: Column, form: Form = Form()) -> Column:
    """The text that an output of the form named was made of."""
    between = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", x) for x in form.marks), -1)
    psm, spm = F.concat(between[1], between[3], between[2]), F.concat(between[2], between[3], between[1])
    return F.when(form_name == "psm", psm).when(form_name == "spm", spm).otherwise(output)


def transformed(docs: DataFrame, grammar: Grammar = TOKENS, form: Form = Form()) -> DataFrame:
    """The documents with the output as their text, all other columns kept; n_chars, if there, is counted anew. The form follows, as fim_form."""
    whole = F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("whole")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), whole)
    new = {"text": F.col("output"), "n_chars": F.char_length("output")}
    kept = [(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"whole.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return _parted(rows, grammar, form, "whole").select(*kept, F.col("form").alias(spare(docs.columns, "fim_form")))


def digests(made: DataFrame, form: Form = Form()) -> DataFrame:
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form"), form), 256).alias("restored_sha256"),
    )
