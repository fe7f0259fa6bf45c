"""Token counts that follow edits: only pre-tokens that an edit changes, with what stands around them, are encoded again.

The tokenizer's pattern cuts a text into pre-tokens, which are encoded one by one, so their counts add up. A document is
a balanced tree whose leaves are small runs of pre-tokens with the count of each; sums over the tree find the leaves of an
edit and give the total. The pattern reads from left to right and looks ahead, but never back: so the leaves from a
few characters before an edit, and from before any white space there, are cut anew, until a cut falls on the end of an
old leaf behind the edit. From there on all is as it was. Of what was cut anew only pre-tokens that differ from the old ones are
encoded, and only the sums above their leaves are made anew, however much is inserted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import CROWD, LISTED, column_or, copied, dealt, materialize

#: Characters of the pre-tokens of a leaf (a longer pre-token stands alone).
LEAF = 64
#: Characters before an edit, and behind a cut, that the pattern may look at besides white space.
CONTEXT = 4

#: A pre-token and its number of tokens.
Unit = tuple[str, int]


class Node:
    """A leaf with its pre-tokens, or an inner node; with the characters and tokens below it."""

    __slots__ = ("left", "right", "units", "chars", "tokens", "height")

    def __init__(self, left: Node | None, right: Node | None, units: list[Unit] | tuple = ()) -> None:
        self.left, self.right, self.units = left, right, units
        if left is None:
            self.chars, self.tokens, self.height = sum(len(u[0]) for u in units), sum(u[1] for u in units), 0
        else:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.height = 1 + max(left.height, right.height)

    @property
    def text(self) -> str:
        return "".join(u[0] for u in self.units)


def _over(left: Node, right: Node) -> Node:
    """A node over both, whose heights differ by 2 at most; turned where they do."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def joined(left: Node | None, right: Node | None) -> Node | None:
    """The leaves of both, in order, as one balanced tree; the work depends on the heights alone."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _over(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _over(joined(left, right.left), right.right)
    return Node(left, right)


def parted(node: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """The leaves before the one that holds the character ``at``, and that one with all after it."""
    if node is None or node.left is None:
        return None, node
    if at < node.left.chars:
        before, rest = parted(node.left, at)
        return before, joined(rest, node.right)
    before, rest = parted(node.right, at - node.left.chars)
    return joined(node.left, before), rest


def _leaves_of(node: Node | None) -> Iterator[Node]:
    if node is not None:
        if node.left is None:
            yield node
        else:
            yield from _leaves_of(node.left)
            yield from _leaves_of(node.right)


class TokenCounter:
    """Counts the ids of a text under a file of byte-pair ranks, whole or by pre-token."""

    #: Pre-tokens whose counts are remembered.
    KEPT = 200_000

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # White space as the tokenizer has it: Python's would take in the separators \x1c to \x1f.
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V0)
        self.known: dict[str, Unit] = {}

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def units(self, text: str) -> list[Unit]:
        """The text's pre-tokens with their counts."""
        pieces, known = self.cut.findall(text), self.known
        if len(known) > self.KEPT:
            known.clear()
        out = []
        for piece in pieces:
            unit = known.get(piece)
            if unit is None:
                unit = known[piece] = (piece, self(piece))
            out.append(unit)
        if sum(map(len, pieces)) != len(text):
            raise ValueError("the pattern must leave no character out")
        return out


class CountTree:
    """A text's token count under edits: a balanced tree of leaves, of which an edit takes some out and puts others in."""

    def __init__(self, text: str, count: TokenCounter) -> None:
        self.count, self.encoded = count, len(text)
        self.root = _tree(count.units(text))

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in _leaves_of(self.root))

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Takes ``removed`` characters away from position ``at`` and puts ``inserted`` there, both held to the text."""
        size = self.root.chars if self.root else 0
        at = min(max(at, 0), size)
        end = min(at + max(removed, 0), size)
        if end == at and not inserted:
            return
        before, rest = parted(self.root, max(at - CONTEXT, 0))
        while before is not None:
            last = before
            while last.left is not None:
                last = last.right
            if not last.units[-1][0][-1].isspace():
                break
            before, tail = parted(before, before.chars - 1)
            rest = joined(tail, rest)
        start = before.chars if before else 0
        # The leaves up to the one behind the edit, and more if no cut falls on their end.
        more = max(end - start, 0) + 1
        while True:
            touched, after = parted(rest, more)
            if after is not None:
                first = after
                while first.left is not None:
                    first = first.left
                leaf, after = parted(after, first.chars)
                leaf, after = (leaf, after) if leaf is not None else (first, None)
                touched = joined(touched, leaf)
            old = [u for leaf in _leaves_of(touched) for u in leaf.units]
            part = "".join(u[0] for u in old)
            part = part[: at - start] + inserted + part[end - start :]
            units = self._cut(part, after)
            if units is not None:
                break
            more = 2 * touched.chars
        same = _shared(old, units)
        behind = _shared(old[same:][::-1], units[same:][::-1])
        self.encoded += sum(len(u[0]) for u in units[same : len(units) - behind])
        self.root = joined(joined(before, _tree(units)), after)

    def _cut(self, part: str, after: Node | None) -> list[Unit] | None:
        """The pre-tokens of ``part`` where the leaves ``after`` follow it; none if no cut falls on its end."""
        ahead = ""
        for leaf in _leaves_of(after):
            ahead += leaf.text
            if len(ahead.lstrip()) > CONTEXT:
                break
        units, end, k = self.count.units(part + ahead), 0, 0
        while end < len(part):
            end += len(units[k][0])
            k += 1
        return units[:k] if end == len(part) else None


def _shared(left: list[Unit], right: list[Unit]) -> int:
    """How many units both begin with."""
    n = 0
    for a, b in zip(left, right, strict=False):
        if a != b:
            break
        n += 1
    return n


def _tree(units: list[Unit]) -> Node | None:
    """A balanced tree over leaves of these units."""
    level, chars, first = [], 0, 0
    for k, (piece, _) in enumerate(units):
        if chars and chars + len(piece) > LEAF:
            level.append(Node(None, None, tuple(units[first:k])))
            chars, first = 0, k
        chars += len(piece)
    if first < len(units):
        level.append(Node(None, None, tuple(units[first:])))
    while len(level) > 1:
        level = [Node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        if len(level) > 1 and level[-1].height < level[-2].height - 1:  # a short end is joined where it fits
            level[-2:] = [joined(level[-2], level[-1])]
    return level[0] if level else None


_counters: dict[tuple[str, str], TokenCounter] = {}


def token_counter(ranks_file: str, pattern: str) -> TokenCounter:
    """The counter of a file of byte-pair ranks; one for each process."""
    if (ranks_file, pattern) not in _counters:
        _counters[ranks_file, pattern] = TokenCounter(ranks_file, pattern)
    return _counters[ranks_file, pattern]


def counts_after_edits(docs: DataFrame, edits: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, tokens_before, tokens_after, n_edits, chars_encoded, chars_again for every row of ``docs``.

    ``edits`` (doc_id, edit_no, at, removed, inserted) apply in the order of edit_no (then of their other
    columns), each to the text that the edits before it leave; positions count code points and are held to the
    text, nulls count as 0 and as nothing. ``chars_encoded`` counts the characters of the first count,
    ``chars_again`` those encoded for the edits.

    A null text is empty; edits of unknown documents and of null doc_ids do nothing; edits apply to each row of
    a repeated doc_id. Rows that agree in doc_id and text share one tree, and very many of them are dealt to several
    tasks; other texts of a doc_id are worked on for themselves. The edits of a text pass through its task one
    by one, they are never gathered. Rows without a doc_id are counted where they are. Further columns are ignored;
    empty tables give empty results or counts without edits.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("body"))
    named = texts.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("body"))
    keys = ["doc_id", "h"]
    slim = materialize(named.groupBy(*keys).agg(F.count("*").alias("n")), "texts")
    hot = materialize(slim.where(F.col("n") > CROWD).select(*keys, F.ceil(F.col("n") / CROWD).cast("int").alias("salts")), "crowded")
    hot = F.broadcast(hot) if hot.count() <= LISTED else hot
    none = F.lit(0).cast("long")
    rows = dealt(named, hot, keys, F.monotonically_increasing_id()).select(*keys, "_salt", F.lit(0).alias("kind"), none.alias("edit_no"), none.alias("at"), none.alias("removed"), "body")
    changes = edits.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.lit(1).alias("kind"), F.coalesce("edit_no", F.lit(0)).cast("long").alias("edit_no"),
        F.coalesce("at", F.lit(0)).cast("long").alias("at"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"),
        F.coalesce("inserted", F.lit("")).alias("body"),
    )
    rows = rows.unionByName(copied(changes.join(slim.select(*keys), "doc_id"), hot, keys).select(*rows.columns))
    rows = rows.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "kind", "edit_no", "at", "removed", "body")
    kinds = [pa.int64()] * 6
    names = ["doc_id", "tokens_before", "tokens_after", "n_edits", "chars_encoded", "chars_again"]
    schema = ", ".join(f"{c} long" for c in names)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(ranks_file, pattern)
        current, tree, before, first, copies, edited, out = None, None, 0, 0, 0, 0, []
        for batch in batches:
            for doc_id, h, salt, kind, at, removed, body in zip(*(column_or(batch, c).to_pylist() for c in (*keys, "_salt", "kind", "at", "removed", "body")), strict=True):
                if current != (doc_id, h, salt):
                    out += [(current[0], before, tree.total, edited, first, tree.encoded - first)] * copies if current else []
                    current, copies, edited = (doc_id, h, salt), 0, 0
                    tree = CountTree(body if kind == 0 else "", count)
                    before, first = tree.total, tree.encoded
                if kind == 0:
                    copies += 1
                elif copies:
                    edited += 1
                    tree.edit(at, removed, body)
            if out:
                yield packed(out)
                out = []
        if current and copies:
            yield packed([(current[0], before, tree.total, edited, first, tree.encoded - first)] * copies)

    def only_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(ranks_file, pattern)
        for batch in batches:
            found = [(None, n, n, 0, len(x), 0) for x in column_or(batch, "body").to_pylist() for n in (count(x),)]
            if found:
                yield packed(found)

    counted = rows.select(*keys, "_salt", "kind", "at", "removed", "body").mapInArrow(follow, schema)
    return counted.unionByName(texts.where("doc_id IS NULL").mapInArrow(only_count, schema))
