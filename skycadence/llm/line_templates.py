"""Line de-duplication by a log-template tree: lines that recur across documents up to variable fields are dropped.

One pass reduces the corpus to its distinct lines, each with the smallest and the largest content that holds it: two that
differ say "in two documents", and they combine on the map side. Tokens are only looked at in leaves that hold a line of one
document beside lines of others; where every line of a leaf recurs word for word, all its tokens are constant anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycadence.llm import textkit as tk
from skycadence.llm.filters import flags, key_filter
from skycadence.llm.shared import documents, join_hot, text_or_empty, written

DEPTH = 3  # leading tokens on the path to a leaf, after the token count
CONSTANT = 0.6  # share of a template's tokens that are not variable, at least
SHARED, MIXED = 1, 2  # leaves of two documents; those that also have a line of one document alone
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_VARIABLE = np.uint64(0x1F83D9ABFB41BD6B)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines:
    """The lines of a slice of rows that have tokens, as arrays."""

    def __init__(self, part: np.ndarray, cut: np.ndarray):
        s, e, _ = tk.words(part, cut)
        hashes = tk.span_hashes(part, s, e, tk.BYTE)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[part])])
        hashes[digits[e] > digits[s]] = _VARIABLE  # a token with a digit is a variable field
        breaks = np.flatnonzero(part == 10)
        row = np.searchsorted(cut, s, "right") - 1
        number = np.searchsorted(breaks, s) - np.searchsorted(breaks, cut)[row]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(fresh)
        self.words, self.first = hashes, np.append(first, len(s))
        self.row, self.number = row[first], number[first]
        n = np.diff(self.first)
        leaf = n.astype(np.uint64) * _K[0]
        for k in range(DEPTH):
            has = n > k
            leaf[has] += hashes[first[has] + k] * _K[1 + k]
        self.leaf = tk.scramble(leaf)
        up, down = tk.powers(len(s) + 1)
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(hashes * up[:len(s)], out=total[1:])
        at = np.searchsorted(breaks, s[first])
        start = np.maximum(np.append(-1, breaks)[at] + 1, cut[self.row])
        end = np.minimum(np.append(breaks, len(part))[at], cut[self.row + 1])
        self.exact = tk.span_hashes(part, start, end, tk.BYTE)
        self.line = tk.scramble((total[self.first[1:]] - total[self.first[:-1]]) * down[first] + n.astype(np.uint64))


def _slices(column: pa.Array) -> Iterator[tuple[int, Lines]]:
    buf, offs = tk.utf8(column)
    for lo, hi in tk.slices(offs):
        yield lo, Lines(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])


def _content(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("content")))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(leaf, line, lo, hi): each distinct line of tokens, and the smallest and largest content with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = _content(batch)
            for lo, lines in _slices(batch.column("text")):
                mine = content[lo + lines.row]
                order = np.lexsort((mine, lines.line, lines.leaf))
                leaf, line, mine = lines.leaf[order], lines.line[order], mine[order]
                fresh = np.ones(len(line), bool)
                fresh[1:] = (leaf[1:] != leaf[:-1]) | (line[1:] != line[:-1])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(line)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (leaf[first], line[first], mine[first], mine[last])],
                                                 ["leaf", "line", "lo", "hi"])
    found = docs.select("content", "text").mapInArrow(run, "leaf long, line long, lo long, hi long")
    return found.groupBy("leaf", "line").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def mixed_tokens(docs: DataFrame, leaves) -> DataFrame:
    """(leaf, line, size, path, own, token, lo, hi): of each distinct line of a slice in a mixed leaf, a row for every token beyond
    the path that has no digit (hashed with its leaf and place), and one row of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(leaves.value, np.uint8)
        for batch in batches:
            content = _content(batch)
            for lo, lines in _slices(batch.column("text")):
                at = np.flatnonzero(flags(table, lines.leaf) & MIXED)
                mine = content[lo + lines.row[at]]
                order = np.lexsort((mine, lines.line[at]))
                at, mine = at[order], mine[order]
                first = np.flatnonzero(np.append(True, lines.line[at][1:] != lines.line[at][:-1])) if len(at) else np.zeros(0, np.int64)
                low, high = mine[first], mine[np.append(first[1:], len(at)) - 1] if len(at) else mine
                at = at[first]
                n = np.diff(lines.first)[at]
                ends = np.concatenate([[0], np.cumsum(n + 1)])
                owner = np.repeat(np.arange(len(at)), n + 1)
                place = np.arange(ends[-1]) - ends[owner] - 1  # -1 stands for the line itself
                word = lines.words[np.maximum(lines.first[at][owner] + place, 0)]
                kept = (place >= DEPTH) & (word != _VARIABLE)
                path = np.bincount(owner[(place >= 0) & (place < DEPTH) & (word != _VARIABLE)], minlength=len(at))
                token = tk.scramble(lines.leaf[at][owner] + place.astype(np.uint64) * _K[0] + word * _K[1])
                token = np.where(place < 0, lines.line[at][owner], token)
                out = np.flatnonzero(kept | (place < 0))
                of = owner[out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.leaf[at][of].view(np.int64)), pa.array(lines.line[at][of].view(np.int64)), pa.array(n[of].astype(np.int32)),
                     pa.array(path[of].astype(np.int32)), pa.array(place[out] < 0), pa.array(token[out].view(np.int64)), pa.array(low[of]), pa.array(high[of])],
                    ["leaf", "line", "size", "path", "own", "token", "lo", "hi"])
    return docs.select("content", "text").mapInArrow(run, "leaf long, line long, size int, path int, own boolean, token long, lo long, hi long")


def templates(tokens: DataFrame, constant: float) -> DataFrame:
    """(leaf, line, template) of the lines of mixed leaves; the template is NULL where too few tokens are constant.

    In its leaf a token is constant at its place if two documents have it there; the tokens on the path to the leaf are
    constant, except those with digits. All other tokens are variable fields. Lines longer than the path need a constant
    token beyond it too: words they begin with alone do not make different lines one template."""
    constants = tokens.where(~F.col("own")).groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(
        "lo <> hi").select("token", F.lit(True).alias("constant"))
    marked = join_hot(tokens.drop("lo", "hi"), constants, ["token"], "left")
    # A line is there once for each slice that holds it: every sum is that many times too large. Longs that are summed as
    # two halves cannot pass 64 bits.
    times, some, part = F.count_if("own"), F.col("constant").isNotNull() & ~F.col("own"), F.xxhash64("token")
    made = marked.groupBy("leaf", "line").agg(
        times.alias("times"), F.max("size").alias("size"), F.max("path").alias("path"), F.count_if(some).alias("beyond"),
        F.sum(F.when(some, F.shiftrightunsigned(part, 33))).alias("high"), F.sum(F.when(some, part.bitwiseAND(F.lit((1 << 31) - 1)))).alias("low"))
    once = [F.coalesce(F.call_function("div", F.col(c), F.col("times")), F.lit(0)).alias(c) for c in ("beyond", "high", "low")]
    made = made.select("leaf", "line", "size", "path", *once)
    enough = (F.col("path") + F.col("beyond") >= constant * F.col("size")) & ((F.col("beyond") > 0) | (F.col("size") <= DEPTH))
    return made.select("leaf", "line", F.when(enough, F.xxhash64("leaf", "size", "high", "low")).alias("template"), F.lit(True).alias("mixed"))


def shared_lines(docs: DataFrame, leaves, constant: float) -> DataFrame:
    """(content, doc_id, number, leaf, line, exact, whole) of each line whose leaf may be shared.

    `exact` is a hash of the line's bytes; `whole` says that the line is a template if all its tokens recur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(leaves.value, np.uint8)
        for batch in batches:
            content, ids = _content(batch), np.asarray(batch.column(0).fill_null(0))
            null = np.asarray(batch.column(0).is_null())
            for lo, lines in _slices(batch.column("text")):
                at = np.flatnonzero(flags(table, lines.leaf) & SHARED)
                n = np.diff(lines.first)
                fixed = np.add.reduceat((lines.words != _VARIABLE).astype(np.int64), lines.first[:-1]) if len(n) else n
                head = sum(((n > k) & (lines.words[np.minimum(lines.first[:-1] + k, max(len(lines.words) - 1, 0))] != _VARIABLE)).astype(np.int64)
                           for k in range(DEPTH)) if len(n) else n
                whole = (fixed >= constant * n) & ((fixed > head) | (n <= DEPTH))
                row = lo + lines.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(content[row]), pa.array(ids[row], mask=null[row]), pa.array(lines.number[at].astype(np.int32)), pa.array(lines.leaf[at].view(np.int64)),
                     pa.array(lines.line[at].view(np.int64)), pa.array(lines.exact[at].view(np.int64)), pa.array(whole[at])],
                    ["content", "doc_id", "number", "leaf", "line", "exact", "whole"])
    return docs.select("doc_id", "content", "text").mapInArrow(
        run, "content long, doc_id long, number int, leaf long, line long, exact long, whole boolean")


def dropped_lines(docs: DataFrame, constant: float = CONSTANT, verbatim: bool = False) -> DataFrame:
    """(content, drops, by_template): for each text, by its hash, the numbers of the lines that go, and how many of them
    the tree drops; the others recur word for word."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("content"), text_or_empty().alias("text"))
    leaves = distinct_lines(docs).groupBy("leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(F.col("lo") == F.col("hi")).alias("single"))
    leaves = written(leaves.where("lo <> hi").select(F.col("leaf").alias("key"), (F.lit(SHARED) + F.when(F.col("single"), MIXED).otherwise(0)).cast("long").alias("flag")), "leaves")
    known = key_filter(leaves, leaves.count())
    made = templates(written(mixed_tokens(docs, known), "tokens"), constant)
    lines = join_hot(shared_lines(docs, known, constant), made, ["leaf", "line"], "left")
    whole = F.when(F.col("whole"), F.xxhash64("leaf", "line"))
    template = F.when(F.col("mixed").isNotNull(), F.col("template")).otherwise(whole)
    lines = lines.select("content", "doc_id", "number", "exact", "leaf", template.alias("template"))
    lines = lines.select("content", "doc_id", "number", F.col("template").isNotNull().alias("tree"),
                         F.coalesce("template", F.xxhash64("leaf", "exact")).alias("template"))  # a line without a template is its own
    lines = written(lines if verbatim else lines.where("tree"), "templates")
    first = F.min_by("content", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "content")))
    recurring = lines.groupBy("template").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), first.alias("first")).where(
        "lo <> hi and first is not null").select("template", "first")
    gone = join_hot(lines, recurring, ["template"]).where("content <> first").select("content", "number", "tree").distinct()
    return gone.groupBy("content").agg(F.collect_list("number").alias("drops"), F.count_if("tree").alias("by_template"))


def drop_recurring_lines(docs: DataFrame, constant: float = CONSTANT, verbatim: bool = False) -> DataFrame:
    """All rows and columns of `docs` with recurring lines taken out of `text`, then n_lines, n_dropped and, of those,
    n_dropped_template and n_dropped_verbatim.

    Lines end at \\n; tokens are split at blanks; blank lines are never dropped. The tree has the token count, then
    the first DEPTH tokens; tokens with a digit are variable fields, and in a leaf so are tokens that one document alone
    has at that place. A template needs a share of at least `constant` constant tokens, and one of them beyond the first
    DEPTH if it is longer. With `verbatim` any other line is its own template, byte for byte; without it such lines stay.
    A template that documents of two different contents hold is recurring: it stays in the document with the smallest
    doc_id (and exact copies of that document, which other operators treat) and its lines go everywhere else. Exact
    copies count as one document, so copying alone makes no template, and so does one document with a token in several
    lines. NULL text stays NULL and has 0 lines; an empty text has 0; a NULL doc_id comes last and never keeps a line that
    an id could keep; repeated rows get the same result. Where no row of a template has an id its lines stay. Input
    columns with the names of the four counts are replaced. An empty table gives an empty result.
    """
    counts = ("n_lines", "n_dropped", "n_dropped_template", "n_dropped_verbatim")
    own = [c for c in docs.columns if c not in counts]
    drops = dropped_lines(docs, constant, verbatim).withColumnsRenamed({"content": "__content", "drops": "__drops", "by_template": "__tree"})
    rows = join_hot(docs.select(*own, F.xxhash64(text_or_empty()).alias("__content")), drops, ["__content"], "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drops"))
    rows = rows.withColumn("__lines", lines).withColumn("__stay", F.when(F.col("__drops").isNotNull(), stay))
    kept = F.array_join(F.transform("__stay", lambda i: F.col("__lines")[i]), "\n")
    text = F.when(F.col("__drops").isNull(), F.col("text")).otherwise(kept)
    n, tree = F.coalesce(F.size(F.col("__drops")), F.lit(0)), F.coalesce(F.col("__tree"), F.lit(0)).cast("int")
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in own], F.when(text_or_empty() == "", 0).otherwise(F.size("__lines")).alias("n_lines"),
                       n.alias("n_dropped"), tree.alias("n_dropped_template"), (n - tree).alias("n_dropped_verbatim"))


def op1_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(documents(spark, sf_dir), verbatim=True).select(
        "doc_id", "text", "n_lines", "n_dropped", "n_dropped_template", "n_dropped_verbatim")
