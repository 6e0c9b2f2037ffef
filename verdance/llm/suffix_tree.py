"""Substring dedup by suffix trees over prefix partitions.

Windows of words whose sequence starts at more than one place are found and the
words under them removed.  ``repeats`` deals contexts to tasks such that equal
windows meet.  A task splits its suffixes by variable-length prefixes: groups
under a short prefix that are too large get a longer one, until a group fits the
memory set aside.  Of each group the suffix tree is built from the top: the
members of a node are split by their next word, children with one suffix in the
whole corpus are leaves and need no more work, and nodes as deep as a window are
the internal nodes whose suffixes are the repeats.

Words are named by 64-bit hashes of their bytes.

Cases: a null text has no words; rows with equal doc_ids are told apart by a hash
of their text, repeated rows are copies of each other; texts shorter than a
window stay whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, repeats

WINDOW = 35
CORE = 8
#: Words of the shortest prefix, suffixes of a group whose tree is built at once,
#: and contexts (of whole keys) that a task judges together.
PREFIX = 4
GROUP = 1 << 18
TOGETHER = 1 << 13


def prefix_groups(held: repeats.Held, at: np.ndarray, window: int, prefix: int = PREFIX, group: int = GROUP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, members, node of each member): bundles of groups that share prefixes of that many words."""
    ranges = base.RangeHash(held.values)
    todo = [(min(prefix, window), np.arange(len(at)))]
    while todo:
        depth, members = todo.pop()
        name = ranges(at[members], at[members] + depth)
        order = np.argsort(name, kind="stable")
        members, name = members[order], name[order]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(name)))
        node = np.repeat(np.arange(len(begin)), size)
        if depth < window:
            big = size > group
            for i in np.flatnonzero(big):  # few: each has more than group members
                todo.append((min(2 * depth, window), members[begin[i]:begin[i] + size[i]]))
            keep = ~big[node]
            members, node, size = members[keep], node[keep], size[~big]
        if not len(members):
            continue
        node = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))
        bundle = (np.cumsum(size) - 1) // group  # groups that fit together
        cut = np.flatnonzero(np.diff(bundle[node])) + 1
        for part, of in zip(np.split(members, cut), np.split(node, cut)):
            yield depth, part, of - of[0]


def deep_nodes(values: np.ndarray, at: np.ndarray, node: np.ndarray, copies: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, its node) of the tree's internal nodes at the depth of a window.

    node: in ascending order, the node at ``depth`` of each member.
    """
    alive = np.arange(len(at))
    while True:
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(node)))
        total = np.add.reduceat(copies[alive], begin) if len(node) else np.zeros(0, int)
        inner = np.repeat(total > 1, size)  # the others are leaves
        alive, node = alive[inner], node[inner]
        if depth == window or not len(alive):
            return alive, node
        word = values[at[alive] + depth]
        edge = np.concatenate([[True], node[1:] != node[:-1]])
        first = np.flatnonzero(edge)
        split = word != np.repeat(word[first], np.diff(np.append(first, len(word))))
        if split.any():  # else every node has one edge and is no branching node
            order = np.lexsort((word, node))
            alive, node, word = alive[order], node[order], word[order]
            edge = np.concatenate([[True], (node[1:] != node[:-1]) | (word[1:] != word[:-1])])
        node = np.cumsum(edge) - 1
        depth += 1


def judge(window: int, prefix: int = PREFIX, group: int = GROUP) -> repeats.Judge:
    """Marks window starts under deep internal nodes."""

    def run(held: repeats.Held) -> np.ndarray:
        at, which = held.starts()
        copies = held.frame["copies"].to_numpy()[which]
        marks = np.zeros(len(at), bool)
        for depth, members, node in prefix_groups(held, at, window, prefix, group):
            found, _ = deep_nodes(held.values, at[members], node, copies[members], depth, window)
            marks[members[found]] = True
        return marks

    return run


def deduplicated(docs: DataFrame, *, window: int = WINDOW, core: int = CORE, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, removed (stretches [lo, hi) of words), kept (the other words, joined by a space)."""
    how = repeats.Sampling(window, core, by_words=True)
    found = repeats.with_spans(docs, base.stored(repeats.spans(docs, how, judge(window), most=TOGETHER, hot=hot), "spans"))
    blanks = "\t\n\x0b\f\r"
    split = F.array_remove(F.split(F.translate("text", blanks, " " * len(blanks)), " ", -1), "")
    found = found.select("doc_id", "removed", split.alias("w"))
    ranges = repeats.kept_ranges(F.col("removed"), F.size("w"))
    rest = F.flatten(F.transform(ranges, lambda x: F.slice("w", x["lo"] + 1, x["n"])))
    kept = F.when(F.size("removed") == 0, F.col("w")).otherwise(rest)
    return found.select("doc_id", F.size("w").cast("long").alias("n_words"), "removed", F.array_join(kept, " ").alias("kept"))
