"""Main-text extraction by wrapper induction over the pages of a host.

Every page becomes a small tree of block elements (runs of alike siblings without blocks of their own are one node).
Pages of a host whose outer containers bear the same labels are of one kind. One page with text of each kind, drawn by a
hash, is its reference; simple tree matching aligns every page of the kind with it. Over all those pages, an aligned slot whose text stays the same is template, one whose text varies is content;
the wrapper is the label path from the root to the smallest container that keeps all varying text but links. A page's main text is
the text in that container without the furniture (menus, forms, notices, ...) its elements declare and without the blocks
that the alignment has shown to be template: blocks with the same text at the same label path on all of REPEATS or more
different pages of a kind that have less such text than varying text. Pages the wrapper
does not fit, or whose kind shows no varying text, use their own main elements, else the body. An element whose name
speaks for furniture is kept where the page's text is in it (see `html.prune`).

Defined results: null or empty html, or a page without text, gives an empty text; a page without a host (null or relative
url) is aligned with none and has no wrapper; character references are decoded once; equal rows get equal results, and of
pages with equal draws the least tree is the reference; extra columns are ignored; no pages give no rows. Very long
pages are read whole; beyond BAND siblings with children, or CELLS cells, siblings are aligned with those near in place
only, so the time for a page grows in proportion to its length.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .html import MAIN, Node, lines, parse

#: Elements a container path may pass through.
CONTAINERS = frozenset("html body div section article main center table tbody tr td #root".split())
#: Different pages of a kind on which a block must stand unchanged to be left out.
REPEATS = 5
#: Wrappers up to which they are broadcast; more are joined by host and kind. A wrapper has at most WRAPPER_LABELS labels.
BROADCAST_WRAPPERS, WRAPPER_LABELS = 20_000, 200
#: Siblings with children beyond which only those near in place are compared, and cells of a table of siblings.
BAND, CELLS = 64, 4_000_000


def _groups(root: Node) -> Iterator[tuple[list[Node], int, int, int, int]]:
    """Nodes in document order, alike leaf siblings as one: (nodes, parent's place, text hash, text length, link length)."""
    stack: list[tuple[Node | list[Node], int]] = [(root, -1)]
    me = -1
    while stack:
        group, parent = stack.pop()
        nodes = group if isinstance(group, list) else [group]
        own, text, links = xxhash.xxh3_64(), 0, 0
        for node in nodes:
            for item in node.items:
                if isinstance(item, (str, tuple)):
                    piece = (item if isinstance(item, str) else item[0]).strip()
                    own.update(piece)
                    text += len(piece)
                    links += 0 if isinstance(item, str) else len(piece)
        me += 1
        yield nodes, parent, own.intdigest() & (1 << 53) - 1, text, links
        children: list[Node | list[Node]] = []
        for child in nodes[0].blocks() if len(nodes) == 1 else []:
            last = children[-1] if children else None
            leaf = not child.blocks()
            if leaf and isinstance(last, list) and last[0].label == child.label:
                last.append(child)
            else:
                children.append([child] if leaf else child)
        stack.extend((c, me) for c in reversed(children))


def skeleton(root: Node) -> list[tuple[int, str, int, int, int]]:
    """Nodes in document order: (parent, label, text hash, text length, link length); alike leaf siblings are one."""
    return [(parent, nodes[0].label, *rest) for nodes, parent, *rest in _groups(root)]


def slots(tree: list) -> list[int]:
    """Of each node, a hash of its label path and text."""
    paths, out = [], []
    for parent, label, text, *_ in tree:
        paths.append(xxhash.xxh3_64_intdigest(label, paths[parent] if parent >= 0 else 0))
        out.append(xxhash.xxh3_64_intdigest(str(text), paths[-1]) & (1 << 53) - 1)
    return out


def without(root: Node, fixed: frozenset[int]) -> None:
    """Takes the text of the slots in `fixed` out of the page."""
    groups = list(_groups(root))
    tree = [(parent, nodes[0].label, *rest) for nodes, parent, *rest in groups]
    for (nodes, _, _, text, _), slot in zip(groups, slots(tree), strict=True):
        if text and slot in fixed:
            for node in nodes:
                node.items = [x for x in node.items if isinstance(x, Node)]


def kind_of(root: Node) -> int:
    """Hash of the labels of a page's containers, down to where they branch."""
    own, node = xxhash.xxh3_64(), root
    while True:
        blocks = node.blocks()
        inner = [c for c in blocks if c.main or c.tag in CONTAINERS]
        own.update("\n".join(sorted({c.label for c in inner})) + "\0")
        if len(blocks) != 1 or not inner or inner[0].main:
            return own.intdigest() & (1 << 53) - 1
        node = inner[0]


def _children(tree: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree]
    for i, node in enumerate(tree):
        if node[0] >= 0:
            out[node[0]].append(i)
    return out


def _paired(xs: list[int], ys: list[int], page: list, reference: list, score: dict[tuple[int, int], int]) -> tuple[list[tuple[int, int]], int]:
    """Best order-keeping pairing of two runs of siblings by the nodes matched below them, and its sum.

    Runs whose table would exceed CELLS are cut into pieces of equal proportion, and piece is paired with piece.
    """
    if len(xs) * len(ys) > CELLS:
        parts = -(-max(len(xs), len(ys)) // 1000)
        out, total = [], 0
        for k in range(parts):
            x, y = (v[len(v) * k // parts : len(v) * (k + 1) // parts] for v in (xs, ys))
            pairs, n = _paired(x, y, page, reference, score)
            out, total = out + pairs, total + n
        return out, total
    worth = np.array([[score.get((x, y), 0) for y in ys] for x in xs]) if len(xs) * len(ys) < 64 else _worth(xs, ys, page, reference, score)
    table = np.zeros((len(xs) + 1, len(ys) + 1), dtype=np.int32)
    for i in range(len(xs)):
        np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + worth[i]), out=table[i + 1, 1:])
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out, int(table[-1, -1])


def _worth(xs, ys, page, reference, score) -> np.ndarray:
    """Matrix of nodes matched below each pair of siblings: 1 for leaves with equal labels, else from score."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(t[v][1], len(names)) for v in run]) for run, t in ((xs, page), (ys, reference)))
    out = (a[:, None] == b[None, :]).astype(np.int32)
    place_x, place_y = {x: i for i, x in enumerate(xs)}, {y: j for j, y in enumerate(ys)}
    bushy = [x for x in xs if page[x][5]], [y for y in ys if reference[y][5]]
    for x in bushy[0]:
        for y in bushy[1]:
            if (x, y) in score:
                out[place_x[x], place_y[y]] = score[x, y]
    return out


def align(page: list, reference: list) -> list[tuple[int, int]]:
    """Pairs (page node, reference node) of a simple tree matching: order kept, roots and labels equal, most nodes.

    Among more than BAND siblings with children, those far apart in place are not compared.
    """
    a_children, b_children = _children(page), _children(reference)
    page = [(*n[:5], bool(a_children[i])) for i, n in enumerate(page)]
    reference = [(*n[:5], bool(b_children[i])) for i, n in enumerate(reference)]
    score: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    stack = [(0, 0, False)]
    while stack:
        a, b, ready = stack.pop()
        if (a, b) in score:
            continue
        xs, ys = a_children[a], b_children[b]
        if not ready:
            stack.append((a, b, True))
            if xs and ys:
                shift = len(ys) / len(xs)
                for i, x in enumerate(xs):
                    if len(ys) <= BAND:
                        near = ys
                    elif page[x][5]:
                        near = ys[max(0, int(i * shift) - BAND // 2) : int(i * shift) + BAND // 2]
                    else:
                        near = ()
                    for y in near:
                        if page[x][1] == reference[y][1] and (page[x][5] or reference[y][5] or len(xs) * len(ys) < 64):
                            stack.append((x, y, False))
            continue
        pairs[a, b], below = _paired(xs, ys, page, reference, score) if xs and ys else ([], 0)
        score[a, b] = 1 + below
    out, stack2 = [], [(0, 0)]
    while stack2:
        at = stack2.pop()
        out.append(at)
        stack2.extend(pairs.get(at, ()))
    return out


def induce(reference: list, stats: dict[int, tuple[int, int, int, int, int]]) -> list[str] | None:
    """Label path of the lowest container of all varying text, None if none varies.

    stats: per node (matched, same, text, links, text below it on pages that the reference has no node for).
    """
    weight = [0] * len(reference)
    for i, (matched, same, text, links, extra) in stats.items():
        weight[i] = extra + (max(0, text - 2 * links) if same < matched else 0)
    for i in range(len(reference) - 1, 0, -1):
        weight[reference[i][0]] += weight[i]
    if weight[0] <= 0:
        return None
    children = _children(reference)
    path, at = [], 0
    while True:
        best = max(children[at], key=lambda c: weight[c], default=None)
        label = reference[at][1]
        done = label.split(".")[0] in MAIN or label.partition(".")[2].lower() in MAIN
        if done or best is None or weight[best] < weight[at] or reference[best][1].split(".")[0] not in CONTAINERS:
            return path
        path.append(reference[best][1])
        at = best


def template_slots(reference: list, stats: dict[int, tuple[int, int, int, int, int]]) -> list[int]:
    """Slots with the same text on all pages of the kind, none if they hold more text than the varying ones.

    Pages that repeat most of their text are copies of one another, not of a template.
    """
    pages = stats[0][0]
    if pages < REPEATS:
        return []
    out, same_text, other_text = [], 0, 0
    for i, slot in enumerate(slots(reference)):
        matched, same, text, links, extra = stats.get(i, (0, 0, 0, 0, 0))
        other_text += extra
        if reference[i][3] and matched == same == pages:
            out.append(slot)
            same_text += max(0, text - 2 * links)
        else:
            other_text += max(0, text - 2 * links)
    return out if same_text < other_text else []


def _follow(root: Node, path: list[str]) -> list[Node]:
    """Nodes that the label path leads to; several where the last label repeats."""
    found = [root]
    for label in path:
        found = [child for node in found for child in node.blocks() if child.label == label]
        if not found:
            return []
    return found


def _mains(root: Node) -> list[Node]:
    """Outermost main elements of the page, whole; where there is a `main`, nothing beside it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.main:
            out.append(node)
        else:
            stack.extend(reversed(node.blocks()))
    return [n for n in out if n.tag == "main" and lines(n)] or out


def main_text(html: str | None, path: list[str] | None, fixed: frozenset[int] = frozenset()) -> str:
    root = parse(html)
    if fixed:
        without(root, fixed)
    chosen = _follow(root, path) if path is not None else []
    blocks = [line for node in chosen for line in lines(node)]
    if not blocks:
        blocks = [line for node in _mains(root) for line in lines(node)]
    blocks = blocks or lines(root)
    if not blocks and fixed:  # nothing but template
        return main_text(html, path)
    if not blocks and html:  # nothing but what bears the names of comments or adverts
        root = parse(html, strict=False)
        blocks = [line for node in _mains(root) for line in lines(node)] or lines(root)
    return "\n".join(blocks)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """host, kind, wrapper (JSON label path) and fixed (JSON template slots), for kinds of pages that show varying text."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                kinds, trees = [], []
                for h in batch.column(2).to_pylist():
                    root = parse(h)
                    tree = skeleton(root)
                    kinds.append(kind_of(root))
                    trees.append(json.dumps(tree, ensure_ascii=False) if any(node[3] for node in tree) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(kinds, pa.int64()), pa.array(trees, pa.string())], ["host", "draw", "kind", "tree"]
                )

    drawn = pages.select(_host(F.col(url)).alias("host"), F.xxhash64(key, url).alias("draw"), F.col(html).alias("html")).filter("host <> ''")
    trees = materialize(drawn.mapInArrow(skeletons, "host string, draw long, kind long, tree string").filter("tree is not null"), "skeletons")
    first = trees.groupBy("host", "kind").agg(F.min("draw").alias("draw"))
    chosen = trees.join(first, ["host", "kind", "draw"], "left_semi").groupBy("host", "kind").agg(F.min("tree").alias("reference"))
    references = materialize(chosen, "references")

    counts = ["matched", "same", "chars", "links", "extra"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
            known: dict[tuple[str, int], list] = {}
            for host, kind, tree, reference in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                page, other = json.loads(tree), known.get((host, kind)) or known.setdefault((host, kind), json.loads(reference))
                pairs = dict(align(page, other))
                for i, node in enumerate(page):
                    if i not in pairs and node[3] > 2 * node[4]:
                        at = node[0]
                        while at not in pairs:
                            at = page[at][0]
                        totals[host, kind, pairs[at]][4] += node[3] - 2 * node[4]
                for i, j in pairs.items():
                    t = totals[host, kind, j]
                    t[0] += 1
                    t[1] += page[i][2] == other[j][2]
                    t[2] += page[i][3]
                    t[3] += page[i][4]
            rows = [(*at, *t) for at, t in totals.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), *[pa.int64()] * 7]
            names = ["host", "kind", "node", *counts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # Copies of a page count once: what they share is no template.
    different = trees.select("host", "kind", "tree").distinct()
    counted = different.join(references, ["host", "kind"]).select("host", "kind", "tree", "reference")
    stats = counted.mapInArrow(aligned, "host string, kind long, node long" + "".join(f", {c} long" for c in counts))
    summed = stats.groupBy("host", "kind", "node").agg(*[F.sum(c).alias(c) for c in counts])
    # A kind's list has as many entries as its reference page has nodes.
    gathered = summed.groupBy("host", "kind").agg(F.to_json(F.collect_list(F.struct("node", *counts))).alias("stats"))

    def induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, fixed = [], []
            for stats, reference in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                by = {x["node"]: tuple(x[c] for c in counts) for x in json.loads(stats)}
                tree = json.loads(reference)
                path = induce(tree, by)
                fixed.append(json.dumps(template_slots(tree, by)))
                paths.append(json.dumps(path, ensure_ascii=False) if path is not None and len(path) <= WRAPPER_LABELS else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array(fixed, pa.string())], ["host", "kind", "wrapper", "fixed"])

    joined = gathered.join(references, ["host", "kind"]).select("host", "kind", "stats", "reference")
    return materialize(joined.mapInArrow(induced, "host string, kind long, wrapper string, fixed string").filter("wrapper is not null"), "wrappers")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars and the wrapper used (null: none) of every row of pages."""
    induced = wrappers(pages, key, url, html)
    if induced.count() <= BROADCAST_WRAPPERS:
        induced = F.broadcast(induced)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), _host(F.col(url)).alias("host"))
    fields = f"key {pages.schema[key].dataType.simpleString()}, url string, "

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                kinds = pa.array([kind_of(parse(h)) for h in batch.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, kinds], ["key", "url", "html", "host", "kind"])

    kinds = rows.mapInArrow(sorted_out, fields + "html string, host string, kind long")
    dressed = kinds.join(induced, ["host", "kind"], "left").select("key", "url", "html", "wrapper", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [
                    main_text(h, json.loads(w) if w else None, frozenset(json.loads(f or "[]")))
                    for h, w, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column(3)],
                    ["key", "url", "text", "n_chars", "wrapper"],
                )

    out = dressed.mapInArrow(run, fields + "text string, n_chars long, wrapper string")
    return out.withColumnRenamed("key", key)
