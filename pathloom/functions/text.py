"""Strings as chat data needs them: Unicode stripping, code fences, JSON replies and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.model import QA


#: The characters that count as white space at a text's ends and between its words.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row: they come out of a generator, which no filter or column is moved into."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def word_count(stripped: Column) -> Column:
    """Words between white space of a stripped text; 0 for an empty one."""
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, f"[{SPACES}]+")))


def unfenced(c: Column) -> Column:
    """A reply without the lines that open and close a code block."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?m)^```(?:json)?\s*", ""), r"(?m)```\s*$", ""))


#: One JSON string literal.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def repaired(c: Column) -> Column:
    """JSON text whose string literals have no raw newline, carriage return or tab left."""
    literal = lambda s: F.replace(F.replace(F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    quoted = F.regexp_extract_all(c, F.lit(f"(?s)({_LITERAL})"), 1)
    between = F.split(c, f"(?s){_LITERAL}", -1)
    return F.array_join(F.flatten(F.zip_with(between, quoted, lambda b, q: F.array(b, F.coalesce(literal(q), F.lit(""))))), "")


def _closed(c: Column) -> Column:
    """Whether nothing but one object, nested or not, stands in the text: from_json would pass over what follows it."""
    bare = F.regexp_replace(c, f"(?s){_LITERAL}", "")
    brackets = F.split(F.regexp_replace(bare, r"[^{}\[\]]+", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc.depth + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc.ends + F.when((x != "") & (depth <= 0), 1).otherwise(0)).alias("ends"))

    whole = F.aggregate(brackets, start, step)
    return bare.rlike(r"(?s)^\{.*\}$") & (whole["depth"] == 0) & (whole["ends"] == 1)


def parsed(clean: Column) -> Column:
    """question, answer and difficulty of a cleaned reply, or null if it is not one JSON object; other keys may hold anything."""
    strict = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    found = F.from_json(clean, QA, strict)
    again = F.from_json(repaired(clean), QA, strict)
    return F.when(_closed(clean), F.when(_usable(found), found).otherwise(F.when(_usable(again), again)))


def _usable(s: Column) -> Column:
    return s.isNotNull() & (s["question"].isNotNull() | s["answer"].isNotNull() | s["difficulty"].isNotNull())


def with_parsed(df: DataFrame, clean: Column, name: str) -> DataFrame:
    """df with parsed(clean) as `name`: each reply is cleaned once, read once, and repaired and read again only where that failed."""
    strict = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    c, found, again = F.col("_clean"), F.col("_found"), F.col("_again")
    df = once(once(df, _clean=clean), _found=F.from_json(c, QA, strict), _closed=_closed(c))
    df = once(df, _again=F.when(F.col("_closed") & ~_usable(found), F.from_json(repaired(c), QA, strict)))
    return once(df, **{name: F.when(F.col("_closed"), F.when(_usable(found), found).otherwise(F.when(_usable(again), again)))}).drop("_clean", "_found", "_closed", "_again")
