"""Text as columns: tokens, phrases, identifiers, snippets. All of it stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and the plain letters that stand for them.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooorrssstuuuuuuuuyyzzz"
assert len(ACCENTED) == len(PLAIN)
# Capitals that lower() turns into two characters, or differently by what stands beside them.
LOWERED = {"İ": "i", "Σ": "σ"}
# Letters and digits of Unicode 14 and 15, which the JVM may not have as such yet.
NEWER = """870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4
10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0
107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59
12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155
1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee
1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af""".split()
TOKEN = r"[\p{L}\p{N}[\x{870}-\x{323af}&&[%s]]]+" % "".join("-".join(r"\x{%s}" % end for end in span.split("-")) for span in NEWER)
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
# Words that never expand a query.
STOP_WORDS = """the and for with this that from into impl pub fn let const static struct enum trait class def return
import package func type var if else match async await use mod crate self super true false none nil null new""".split()


def folded(text: Column) -> Column:
    """In lower case and without accents, each letter by itself. Texts of ASCII alone, told by their bytes, have none to take off."""
    alone = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), LOWERED.items(), text)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(alone), ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without accents."""
    return F.regexp_extract_all(F.coalesce(folded(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def surface_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def fold_words(text: str) -> list[str]:
    """The tokens of a query, on the driver."""
    import re

    return re.findall(r"[^\W_]+", text.translate(str.maketrans(LOWERED)).lower().translate(str.maketrans(ACCENTED, PLAIN)))


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once a row, however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), 0)


def places(toks: Column, hit) -> Column:
    """Places (from 0) of the tokens for which `hit` holds."""
    return F.filter(F.transform(toks, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull())


def phrase_starts(toks: Column, words: list[str], prefix: bool = False) -> Column:
    """Places (from 0) at which the words stand one after another; with `prefix` the last one may go on."""
    last = len(words) - 1

    def starts(k: int) -> Column:
        word = words[k]
        at = places(toks, (lambda t: t.startswith(word)) if prefix and k == last else (lambda t: t == word))
        return F.transform(at, lambda p: p - k) if k else at

    return reduce(F.array_intersect, map(starts, range(len(words))))


def identifiers(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), lambda w: F.length(w) >= 3)


def is_good_term(term: Column) -> Column:
    low = F.lower(term)
    return (F.length(term) >= 3) & ~low.isin(STOP_WORDS) & ~low.rlike("^[0-9]+$")


def cut_bytes(text: Column, most: int) -> Column:
    """The start of a text that takes at most `most` bytes (four or more) of UTF-8 and ends with a whole character."""
    raw = text.cast("binary")
    inside = lambda n: F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
    size = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), size).cast("string"))


def content_snippet(text: Column, lines: int = 3, most: int = 200) -> Column:
    """The first lines, trimmed, blank ones left out, joined by spaces; what takes over `most` bytes is cut with an ellipsis."""
    head = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda s: F.trim(s)), lambda s: s != "")
    joined = F.array_join(head, " ")
    return F.when(F.octet_length(joined) > most, F.concat(cut_bytes(joined, most), F.lit("…"))).otherwise(joined)


def match_snippet(text: Column, words: list[str], size: int = 10) -> Column:
    """The first window of `size` tokens with the most hits; hits in brackets, cut ends marked by an ellipsis."""

    def window(x: Column) -> Column:
        toks, shown, start = x["t"], x["s"], x["at"]
        marked = F.zip_with(F.slice(shown, start + 1, size), F.slice(toks, start + 1, size), lambda s, t: F.when(t.isin(words), F.concat(F.lit("["), s, F.lit("]"))).otherwise(s))
        before, after = F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.when(start + size < F.size(toks), F.lit("…")).otherwise(F.lit(""))
        return F.when(start.isNotNull(), F.concat(before, F.array_join(marked, " "), after))

    def first_best(hits: Column) -> Column:
        counted = F.transform(hits, lambda s: F.struct(F.size(F.filter(hits, lambda p: (p >= s) & (p < s + size))).alias("n"), (-s).alias("minus")))
        return -F.array_max(counted)["minus"]

    at = let(places(tokens(text), lambda t: t.isin(words)), first_best)
    return let(F.struct(tokens(text).alias("t"), surface_tokens(text).alias("s"), at.alias("at")), window)
