"""Rooted label trees: parsing, validation, numbering, names.

A tree is small next to the data (a node for each label) and lives on the driver; its table goes to the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NONE, ROOT = "none", "root"


class HierarchyError(ValueError):
    """An input that is no rooted tree of usable names."""


def parse_edges(lines: Iterable[str]) -> list[tuple[str, str]]:
    """(child, parent) of each line that is not blank; what follows the second word is ignored."""
    out = []
    for line in lines:
        words = line.split()
        if not words:
            continue
        if len(words) < 2:
            raise HierarchyError(f"no parent in line {line!r}")
        out.append((words[0], words[1]))
    return out


@dataclass(frozen=True)
class LabelTree:
    """names and parents by id; the root is its own parent. Provided labels have the first ids."""

    names: tuple[str, ...]
    parents: tuple[int, ...]
    root: int = field(init=False)
    depth: tuple[int, ...] = field(init=False)
    tin: tuple[int, ...] = field(init=False)
    tout: tuple[int, ...] = field(init=False)

    def __post_init__(self):
        n = len(self.names)
        children: list[list[int]] = [[] for _ in range(n)]
        root = next(i for i, p in enumerate(self.parents) if i == p)
        for i, p in enumerate(self.parents):
            if i != p:
                children[p].append(i)
        depth, tin, tout, clock, todo = [0] * n, [0] * n, [0] * n, 0, [(root, False)]
        while todo:
            node, done = todo.pop()
            if done:
                tout[node] = clock - 1
                continue
            tin[node], clock = clock, clock + 1
            todo.append((node, True))
            for c in reversed(children[node]):
                depth[c] = depth[node] + 1
                todo.append((c, False))
        for name, value in (("root", root), ("depth", tuple(depth)), ("tin", tuple(tin)), ("tout", tuple(tout))):
            object.__setattr__(self, name, value)

    @classmethod
    def from_ids(cls, n: int, edges: Sequence[tuple[int, int]], names: Sequence[str] | None = None) -> LabelTree:
        """The tree of n nodes with the edges (child, parent); what is wrong with them is told otherwise."""
        if n < 1:
            raise HierarchyError("a tree has one node at least")
        if len(edges) != n - 1:
            raise HierarchyError(f"a tree of {n} nodes has {n - 1} edges, not {len(edges)}")
        parent: list[int | None] = [None] * n
        for child, up in edges:
            if not (0 <= child < n and 0 <= up < n):
                raise HierarchyError(f"an id in edge {child} {up} is out of range")
            if child == up:
                raise HierarchyError(f"node {child} is its own parent")
            if parent[child] is not None:
                raise HierarchyError(f"node {child} has two parents")
            parent[child] = up
        root = parent.index(None)
        reached, level = {root}, [root]
        by_parent: dict[int, list[int]] = {}
        for i, p in enumerate(parent):
            if p is not None:
                by_parent.setdefault(p, []).append(i)
        while level:
            level = [c for p in level for c in by_parent.get(p, ())]
            reached.update(level)
        if len(reached) != n:
            raise HierarchyError("not all nodes are below the root: there is a cycle")
        return cls(tuple(names or map(str, range(n))), tuple(root if p is None else p for p in parent))

    @classmethod
    def from_edges(cls, labels: Sequence[str], edges: Sequence[tuple[str, str]]) -> LabelTree:
        """Labels have the first ids, other names follow in the order in which edges mention them, child before parent."""
        _check_names(labels, (NONE,))
        if len(set(labels)) != len(labels):
            raise HierarchyError("labels must differ when a hierarchy is given")
        ids = {name: i for i, name in enumerate(labels)}
        for edge in edges:
            for name in edge:
                ids.setdefault(name, len(ids))
        return cls.from_ids(len(ids), [(ids[c], ids[p]) for c, p in edges], list(ids))

    @classmethod
    def star(cls, labels: Sequence[str]) -> LabelTree:
        """All labels below one root."""
        _check_names(labels, (NONE, ROOT))
        n = len(labels)
        return cls(tuple(labels) + (ROOT,), (n,) * (n + 1))

    def __len__(self) -> int:
        return len(self.names)

    def path(self, node: int) -> list[int]:
        """Ids from the root to the node."""
        out = [node]
        while out[-1] != self.root:
            out.append(self.parents[out[-1]])
        return out[::-1]

    def lca(self, a: int, b: int) -> int:
        common = [x for x, y in zip(self.path(a), self.path(b)) if x == y]
        return common[-1]

    def rename(self, names: dict[int, str]) -> LabelTree:
        for i, name in names.items():
            if not 0 <= i < len(self):
                raise HierarchyError(f"there is no label {i}")
            _check_names([name], (NONE,))
        return LabelTree(tuple(names.get(i, old) for i, old in enumerate(self.names)), self.parents)

    def rename_by_name(self, names: dict[str, str]) -> LabelTree:
        ids: dict[str, int] = {}
        for i, name in enumerate(self.names):
            if name in names and name in ids:
                raise HierarchyError(f"several labels are named {name!r}")
            ids[name] = i
        if missing := sorted(set(names) - set(ids)):
            raise HierarchyError(f"there is no label {missing[0]!r}")
        return self.rename({ids[old]: new for old, new in names.items()})

    def nodes(self, spark: SparkSession, paths: bool = False) -> DataFrame:
        """A row for each node, with its place in depth-first order; paths: and its path from the root, which is as long
        as the node is deep."""
        ints = {"parent": self.parents, "depth": self.depth, "tin": self.tin, "tout": self.tout}
        table = {"id": pa.array(range(len(self)), pa.int32()), "name": pa.array(self.names, pa.string())} | {c: pa.array(x, pa.int32()) for c, x in ints.items()}
        if paths:
            table["path"] = pa.array(map(self.path, range(len(self))), pa.list_(pa.int32()))
        return spark.createDataFrame(pa.table(table))

    def dump(self) -> list[str]:
        """Number of nodes, names by id, then child and parent ids of all nodes but the root."""
        edges = [f"{i} {p}" for i, p in enumerate(self.parents) if i != p]
        return [str(len(self)), *self.names, *edges]

    @classmethod
    def from_dump(cls, lines: Sequence[str]) -> LabelTree:
        """The tree of what dump() gave."""
        n = int(lines[0])
        edges = [(int(c), int(p)) for c, p in (x.split() for x in lines[n + 1 :] if x.strip())]
        return cls.from_ids(n, edges, list(lines[1 : n + 1]))

    def taxonomy(self) -> tuple[list[str], list[str]]:
        """Lines of a names and of a nodes table of taxa: ids start at 1, the root, which is its own parent."""
        order = [self.root, *(i for i in range(len(self)) if i != self.root)]
        taxid = {node: i + 1 for i, node in enumerate(order)}
        names = [f"{taxid[i]}\t|\t{self.names[i]}\t|\t\t|\tscientific name\t|" for i in order]
        nodes = [f"{taxid[i]}\t|\t{taxid[self.parents[i]]}\t|\t{'no rank' if i == self.root else 'clade'}\t|" for i in order]
        return names, nodes


def _check_names(names: Iterable[str], reserved: tuple[str, ...]) -> None:
    for name in names:
        if name in reserved:
            raise HierarchyError(f"the name {name!r} is reserved")
