"""Text primitives as Spark expressions, with the semantics of the rule language (ASCII word boundaries, wide white space, UTF-16 lengths)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the rule language.
SPACE_IN_CLASS = r"\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
HIT = "array<struct<pos:int,line:int,match:string>>"


def regex(pattern: str, flags: str = "") -> str:
    """A pattern of the rule language as a Java pattern: \\b by ASCII words, \\s with all Unicode spaces; flags: i, m, s."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            if two == "\\b" and not in_class:
                out.append(WORD_EDGE)
            elif two == "\\s":
                out.append(SPACE_IN_CLASS if in_class else f"[{SPACE_IN_CLASS}]")
            elif two == "\\S" and not in_class:
                out.append(f"[^{SPACE_IN_CLASS}]")
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "[" and in_class:
            out.append("\\")  # a bare bracket in a class nests in Java
        out.append(c)
        i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def trimmed(text: Column) -> Column:
    """Without white space at both ends; a pattern for trailing white space would be tried anew at every space of the text."""
    return F.btrim(text, F.lit(SPACES))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` has it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def line_count(text: Column) -> Column:
    """Newlines in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


#: Matches that are folded at once: appending to an array copies it, so long lists are folded in runs.
RUN = 64


def matches(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern that can't match nothing: array of (pos from 0, line from 1, match), in order."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(parts, found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())  # the last part ends without a match
    empty = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.array().cast(HIT).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        pos, line = acc["pos"] + F.length(x["p"]), acc["line"] + line_count(x["p"])
        hit = F.struct(pos.cast("int").alias("pos"), line.cast("int").alias("line"), x["m"].alias("match"))
        return F.struct((pos + F.length(x["m"])).cast("int").alias("pos"), (line + line_count(x["m"])).cast("int").alias("line"), F.array_append(acc["out"], hit).alias("out"))

    def join(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda h: F.struct((h["pos"] + acc["pos"]).alias("pos"), (h["line"] + acc["line"] - 1).alias("line"), h["match"].alias("match")))
        return F.struct((acc["pos"] + run["pos"]).alias("pos"), (acc["line"] + run["line"] - 1).alias("line"), F.array_append(acc["out"], moved).alias("out"))

    def in_runs(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / F.lit(RUN)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.aggregate(F.slice(all_, c * RUN + 1, F.lit(RUN)), empty, step))
        start = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.array().cast(f"array<{HIT}>").alias("out"))
        return F.flatten(F.aggregate(runs, start, join, lambda acc: acc["out"]))

    return F.when(text.rlike(pattern), let(pairs, in_runs)).otherwise(F.array().cast(HIT))


def line_of(text: Column, pos: Column) -> Column:
    """The 1-based line of a 0-based place."""
    return line_count(F.substring(text, F.lit(1), pos)) + 1


def word_set(text: Column) -> Column:
    """Distinct lower-case words [a-z0-9]+ of more than one character."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def round2(x: Column) -> Column:
    """Two decimals, halves upwards."""
    return F.floor(x * 100 + 0.5) / 100


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), f"[-_{SPACE_IN_CLASS}]", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE_IN_CLASS}]+"), lambda w: w != ""))


def filled_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_IN_CLASS}]")))


# Function words of other languages.
FOREIGN = regex(r"(?<![\w])(?:der|die|das|und|nicht|wenn|für|eine?[nmr]?|möchte|verwenden|benutzer|oder|dans|pour|une|avec|les|des|cuando|para|los|las|usar|também|quando|não|ou)(?![\w])", "iu")


def mostly_english(text: Column) -> Column:
    """Few letters beyond ASCII and fewer than two function words of other languages."""
    ascii_letters, others = F.length(F.regexp_replace(text, "[^a-zA-Z]+", "")), F.length(F.regexp_replace(text, r"[\x00-\x7F\P{L}]+", ""))
    share = F.try_divide(ascii_letters, ascii_letters + others)  # null without letters, when there are no words either
    return F.coalesce(share >= 0.66, F.lit(True)) & (F.regexp_count(text, F.lit(FOREIGN)) < 2)


def fenced_blocks(body: Column) -> Column:
    """(open line from 1, lines inside) of each block between lines that start with ```; a block left open ends with the text."""
    lines = F.split(body, "\n", -1)
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(regex(r"^\s*```")), i)), lambda i: i.isNotNull())
    return F.transform(F.filter(F.transform(marks, lambda i, k: F.struct(i.alias("i"), k.alias("k"))), lambda x: x["k"] % 2 == 0), lambda x: F.struct((x["i"] + 1).alias("open_line"), (F.coalesce(F.get(marks, x["k"] + 1), F.size(lines)) - x["i"] - 1).alias("lines")))


def approximate_tokens(text: Column) -> Column:
    """A stand-in for a tokenizer's count: a token for every four bytes. Pass real counts where they matter."""
    return F.ceil(F.octet_length(text) / 4).cast("int")
