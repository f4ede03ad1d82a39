"""A walk along the macros of LaTeX sources: braces are matched by depth, so nested arguments stay whole.

A small walk along one source's tokens tells which brace closes which and what stands before a group; texts, kinds and rows
are Spark's. Groups that follow a macro, one after the other, are its arguments. Sources are read tolerantly: a brace without
its other half groups nothing, comments are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators.entries import find_dates

#: A comment, a command, an escaped sign, a brace, a line end, or a run of anything else.
TOKEN = r"(?<!\\)%[^\n]*|\\[A-Za-z@]+\*?|\\[^A-Za-z]|[{}]|\n|[^\\{}%\n]+"
HEADINGS = ["\\section", "\\section*", "\\subsection", "\\subsection*", "\\cvsection", "\\chapter"]
#: Tokens that end an item.
MARKS = frozenset(["\\item", "\\begin", "\\end", *HEADINGS])
UNSEEN = ["\\phantom", "\\hphantom", "\\vphantom"]
PALE = r"^(?i)(white|#?fff(fff)?|1,\s*1,\s*1|255,\s*255,\s*255|gray!?[0-5])$"
#: Points under which type can't be read; characters of a date at most.
TINY, DATE_CHARS = 4, 40


def _blank(pattern: str) -> re.Pattern:
    """A pattern that counts white space as Java does, also before a line end that closes the text."""
    return re.compile(pattern + "[\\x85\\u2028\\u2029]?", re.ASCII)


_TOKENS, _EMPTY, _SPACE = re.compile(TOKEN), _blank(r"\s*(?:\[[^\]]*\]\s*)?"), _blank(r"\s+")

#: Of _calls.
CALLS = "array<struct<i: bigint, name: string, line: bigint, nested: boolean, spans: array<struct<first: bigint, last: bigint>>>>"


def matched(text: str) -> list[tuple]:
    """(i, name, line, nested, spans) of the macros of one source that groups follow, and of its items, by place.

    i counts tokens, comments too. spans: first and last token of each group, one after the other; an item's is its place and
    the next item, heading or edge of an environment. nested: an earlier macro's groups reach beyond it. Blanks, one line end
    and an option in brackets may stand before a group. A brace closes the one opened at its depth.
    """
    line, open_, before, back = 1, 0, (-1, "", 1), ("", "")
    groups: dict[int, tuple] = {}  # by depth: the open brace and what stood before it
    runs: dict[int, tuple] = {}  # by depth: where the last group ended, and its macro's spans
    calls, item = [], None
    for i, token in enumerate(_TOKENS.findall(text)):
        if token[0] == "%":
            continue
        if token == "{":
            open_ += 1
            groups[open_] = (i, before)
        elif token == "}":
            if open_ > 0:
                first, head = groups.pop(open_)
                ended, spans = runs.get(open_, (-1, []))
                if head[1] != "}" or head[0] != ended:
                    spans = []
                    if head[1][:1] == "\\" and head[1][1:2].isascii() and head[1][1:2].isalpha():
                        calls.append((head[0], head[1], head[2], spans))
                spans.append((first, i))
                runs[open_] = (i, spans)
            open_ -= 1
        elif token in MARKS:
            if item:
                item.append((item.pop(), i))
            item = None
            if token == "\\item":
                calls.append((i, token, line, item := [i]))
        if token[0] in "\\{}" or not _EMPTY.fullmatch(token):
            before = (i, token, line)
        elif token == "\n" and (back[1] == "\n" or (back[0] == "\n" and _SPACE.fullmatch(back[1]))):
            before = (i, "", line)
        back = (back[1], token)
        line += token == "\n"
    if item:
        item.append((item.pop(), 1 << 40))
    out, reach = [], -1
    for i, name, at, spans in sorted(calls):
        out.append((i, name, at, reach > i, spans))
        if name != "\\item":
            reach = max(reach, spans[-1][1])
    return out


def _calls(texts: pa.Array) -> pa.Array:
    """matched() of each text; what comes back are places, so it is built column by column."""
    edges, span_edges, rows, first, last = [0], [0], [], [], []
    for text in texts:
        for *row, spans in matched(text.as_py() or ""):
            rows.append(row)
            first += [s[0] for s in spans]
            last += [s[1] for s in spans]
            span_edges.append(len(first))
        edges.append(len(rows))
    i, name, line, nested = zip(*rows, strict=True) if rows else ((), (), (), ())
    spans = pa.ListArray.from_arrays(pa.array(span_edges, pa.int32()), pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"]))
    held = [pa.array(i, pa.int64()), pa.array(name, pa.string()), pa.array(line, pa.int64()), pa.array(nested, pa.bool_()), spans]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(held, ["i", "name", "line", "nested", "spans"]))


def _plain(held: Column) -> Column:
    """The text of tokens: commands and braces go, escaped signs stay, white space is made one space."""
    kept = F.transform(held, lambda t: F.when(t.rlike(r"^\\[&%$#_{}]$"), F.substring(t, 2, 1)).when(t == "\\\\", " ").when(t.rlike(r"^[\\%]") | t.isin("{", "}"), "").otherwise(t))
    return F.btrim(F.regexp_replace(F.array_join(kept, ""), r"\s+", " "))


def events(docs: DataFrame) -> DataFrame:
    """doc_id, line, kind, name, text, args: headings, items, entries (other macros with two arguments or more outside others'
    arguments) and hidden text, in order of i.

    A source stays one row until its macros are known, so nothing of it is shuffled. Arguments are slices of its tokens, which
    are one array: they are one source file.
    """
    text = text_of(F.col("text"))
    # The same expression cuts tokens here and in the walk, so places agree.
    whole = docs.select("doc_id", F.arrow_udf(_calls, CALLS)(text).alias("calls"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("held"))

    def inside(held: Column, span: Column) -> Column:
        last = F.least(span["last"], F.size(held).cast("long"))
        return _plain(F.slice(held, (span["first"] + 2).cast("int"), F.greatest(last - span["first"] - 1, F.lit(0)).cast("int")))

    taken = whole.select("doc_id", F.explode(F.transform("calls", lambda c: F.struct(c["i"].alias("i"), c["name"].alias("name"), c["line"].alias("line"), c["nested"].alias("nested"), F.transform(c["spans"], lambda s: inside(F.col("held"), s)).alias("args")))).alias("e")).select("doc_id", "e.*")
    name, first = F.col("name"), F.get("args", F.lit(0))
    hidden = F.when(name.isin(UNSEEN), first).when(name.isin("\\textcolor", "\\colorbox") & first.rlike(PALE), F.get("args", F.lit(1))).when((name == "\\fontsize") & (first.try_cast("double") < TINY), F.get("args", F.lit(2)))
    kind = F.when(hidden != "", "hidden").when(name.isin(HEADINGS), "heading").when(name == "\\item", "item").when(~F.col("nested") & (F.size("args") >= 2) & ~name.isin("\\newcommand", "\\renewcommand", "\\href", "\\textcolor", "\\begin"), "entry")
    rows = taken.withColumns({"kind": kind, "text": F.when(hidden != "", hidden).otherwise(first)}).filter("kind is not null")
    return rows.select("doc_id", "i", "line", "kind", "name", "text", "args")


def model(found: DataFrame) -> DataFrame:
    """doc_id, line_id, section, entry, kind, title, tags, dates, subtitle, text: events as rows of a document.

    An entry's arguments are told by what they hold: one of under DATE_CHARS characters with a date is its dates, the first
    other one its title ('a | b' has tags), the next its subtitle; further ones (places) go. Items belong to the entry
    before them in their section. Ids are t and the line, with a letter from the second event of a line on.
    """
    order = Window.partitionBy("doc_id").orderBy("i")
    section = Window.partitionBy("doc_id", "section").orderBy("i")
    same = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("i"))
    rows = found.withColumn("section", F.sum((F.col("kind") == "heading").cast("long")).over(order))
    rows = rows.withColumn("entry", F.sum((F.col("kind") == "entry").cast("long")).over(section))
    dated = F.filter("args", lambda a: (F.length(a) < DATE_CHARS) & (find_dates(a) != ""))
    other = F.filter(F.array_except("args", dated), lambda a: a != "")
    parts = F.split(F.coalesce(F.get(other, F.lit(0)), F.lit("")), r"\s*\|\s*", 2)
    is_entry = F.col("kind") == "entry"
    line_id = F.concat(F.lit("t"), F.col("line").cast("string"), F.when(same > 1, F.char(same + 95)).otherwise(""))
    return rows.select(
        "doc_id", line_id.alias("line_id"), "section", "entry", "kind", F.when(is_entry, F.get(parts, F.lit(0))).alias("title"), F.when(is_entry, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("tags"),
        F.when(is_entry, find_dates(F.coalesce(F.get(dated, F.lit(0)), F.lit("")))).alias("dates"), F.when(is_entry, F.coalesce(F.get(other, F.lit(1)), F.lit(""))).alias("subtitle"), F.when(~is_entry, F.col("text")).alias("text"),
    )
