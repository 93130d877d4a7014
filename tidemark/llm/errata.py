"""Pairs of strings that are one edit apart, by errata tries.

The strings of a group stand in a trie whose single-child chains are one edge. Every node has a heavy child, the one with
most strings below; the other, light ones hold each string at most log2(n) times. At each node

* replaced: the light subtrees, their first character left open, are merged into one errata trie, the small into the
  large; strings that end at one place there, or at one place of it and of the heavy subtree, differ in that character;
* skipped: a child's subtree without its first character is walked together with the node's own subtree; strings that end
  together differ by that character. A walk goes on only where both have a child, so it costs no more than the lighter.

Two strings meet at the node where they part, so a pair comes up once. Walks use a stack: a string may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """``edge`` leads to it; ``ends`` are the strings that end here; ``size`` counts those at and below it."""

    __slots__ = ("edge", "below", "ends", "size")

    def __init__(self, edge: str):
        self.edge, self.below, self.ends, self.size = edge, {}, [], 0


def add(root: Node, text: str, number: int, start: int = 0) -> Node:
    """The node where ``text[start:]`` ends; an edge that it leaves half way is cut in two."""
    node, at = root, start
    node.size += 1
    while at < len(text):
        child = node.below.get(text[at])
        if child is None:
            child = node.below[text[at]] = Node(text[at:])
            node, at = child, len(text)
        else:
            edge, shared = child.edge, 1
            if text.startswith(edge, at):
                shared = len(edge)
            else:
                most = min(len(edge), len(text) - at)
                while shared < most and edge[shared] == text[at + shared]:
                    shared += 1
                middle = Node(edge[:shared])
                middle.size, middle.below[edge[shared]] = child.size, child
                child.edge = edge[shared:]
                node.below[text[at]] = child = middle
            node, at = child, at + shared
        node.size += 1
    node.ends.append(number)
    return node


#: A place in a trie: a node and how much of its edge is behind.
Place = tuple[Node, int]


def ends_at(place: Place) -> list[int]:
    return place[0].ends if place[1] == len(place[0].edge) else []


def branches(place: Place) -> dict[str, Place]:
    node, done = place
    if done < len(node.edge):
        return {node.edge[done]: place}
    return {c: (child, 0) for c, child in node.below.items()}


def together(a: Place, b: Place) -> Iterator[tuple[list[int], list[int]]]:
    """Ends at the same place below ``a`` and below ``b``."""
    left = [(a, b)]
    while left:
        (x, i), (y, j) = left.pop()
        n = min(len(x.edge) - i, len(y.edge) - j)
        if n and x.edge[i : i + n] != y.edge[j : j + n]:
            continue
        i, j = i + n, j + n
        if ends_at((x, i)) and ends_at((y, j)):
            yield x.ends, y.ends
        if i < len(x.edge):
            if (child := y.below.get(x.edge[i])) is not None:
                left.append(((x, i), (child, 0)))
        elif j < len(y.edge):
            if (child := x.below.get(y.edge[j])) is not None:
                left.append(((child, 0), (y, j)))
        else:
            few, many = (x.below, y.below) if len(x.below) <= len(y.below) else (y.below, x.below)
            left += [((x.below[c], 0), (y.below[c], 0)) for c in few if c in many]


def below(place: Place) -> Iterator[tuple[str, list[int]]]:
    """What leads from ``place`` to each place where strings end, and those."""
    left = [("", place)]
    while left:
        way, (node, done) = left.pop()
        way += node.edge[done:]
        if node.ends:
            yield way, node.ends
        left += [(way, (child, 0)) for child in node.below.values()]


def one_edit_pairs(texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, at, reach) of each pair of distinct texts one edit apart, once: the texts are alike before ``at``, which is as
    great as can be. For a replaced character i < j; otherwise text i is text j with the character at ``at`` left out.
    ``reach`` is 1 if text i ends at ``at``, else 0."""
    root = Node("")
    for number, text in enumerate(texts):
        add(root, text, number)
    left = [(root, 0)]
    while left:
        node, depth = left.pop()
        left += [(child, depth + len(child.edge)) for child in node.below.values() if child.size > 1]
        if not node.below:
            continue
        if len(node.below) > 1:
            heavy = max(node.below.values(), key=lambda child: child.size)
            light = sorted((child for child in node.below.values() if child is not heavy), key=lambda child: -child.size)
            errata = Node("")
            for child in light:
                for way, ends in below((child, 1)):
                    place = add(errata, way, ends[0])
                    yield from ((min(i, ends[0]), max(i, ends[0]), depth, 0) for i in place.ends[:-1])
            for some, others in together((errata, 0), (heavy, 1)):
                yield from ((min(i, j), max(i, j), depth, 0) for i in some for j in others)
        for first, child in node.below.items():
            skipped = (child, 1)
            if node.ends and ends_at(skipped):
                yield node.ends[0], child.ends[0], depth, 1
            for c, place in branches(skipped).items():
                if c != first and c in node.below:
                    yield from ((j[0], i[0], depth, 0) for i, j in together(place, (node.below[c], 0)))
