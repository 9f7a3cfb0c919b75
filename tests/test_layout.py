"""Layouts against a plain recursive version: nothing overlaps, children lie inside."""

import math
import random
import re

from weftline.operators.layout import Measures, layout


def plain(nodes):
    m, kids = Measures(), {}
    for p, n in nodes.items():
        kids.setdefault(n["parent"] if n["parent"] in nodes else None, []).append(p)

    def columns(of):
        by = {}
        for p in kids.get(of, []):
            found = re.match(r"\d+([A-Z])", nodes[p]["key"])
            by.setdefault(found[1] if found else "_", []).append(p)
        out = []
        for letter in sorted(by):
            some = sorted(by[letter], key=lambda p: (nodes[p]["key"], p))
            each = math.ceil(len(some) / math.ceil(len(some) / m.column_nodes)) if len(some) > m.column_nodes else len(some)
            out += [some[i : i + each] for i in range(0, len(some), each)]
        return out

    def size(p):
        n, cols = nodes[p], columns(p)
        width = max(m.node_min_width, max(map(len, n["label"].split("\n"))) * m.char_width + m.label_padding)
        if not cols:
            return width, m.node_height + (m.header if n["is_dir"] else 0)
        heights = [sum(size(c)[1] for c in col) + m.row_gap * (len(col) - 1) + (i % 2) * 34 for i, col in enumerate(cols)]
        return sum(max(size(c)[0] for c in col) for col in cols) + 2 * m.padding_x + m.column_gap * (len(cols) - 1), m.header + 2 * m.padding_y + max(heights)

    out = {}

    def place(of, x, y):
        for i, col in enumerate(columns(of)):
            width, at = max(size(c)[0] for c in col), y + (i % 2) * 34
            seen = 0
            for c in col:
                w, h = size(c)
                seen = max(seen, w)
                left = x + ((seen if of is None else width) - w) / 2
                out[c] = (left, at, w, h)
                place(c, left + m.padding_x, at + m.header + m.padding_y)
                at += h + (m.tier_gap if of is None else m.row_gap)
            x += width + m.column_gap

    place(None, m.canvas, m.canvas)
    return out


def test_layout_equals_a_walk(spark):
    r = random.Random(12)
    nodes, dirs = {}, [None]
    for i in range(160):
        parent, is_dir = r.choice(dirs), r.random() < 0.25
        path = f"n{i:03d}"
        nodes[path] = {"parent": parent if r.random() < 0.97 else "gone", "is_dir": is_dir, "key": r.choice(["1A", "1B", "2A", "12C", "x"]) + str(r.randint(0, 20)), "label": "w" * r.randint(1, 40) + r.choice(["", "\nsecond line of it"])}
        if is_dir:
            dirs.append(path)
    df = spark.createDataFrame([(p, n["parent"], n["is_dir"], n["key"], n["label"]) for p, n in nodes.items()], "path string, parent string, is_dir boolean, key string, label string")
    rows = layout(df).collect()
    assert {b.path: (b.x, b.y, b.width, b.height) for b in rows} == plain(nodes)
    at = {b.path: b for b in rows}
    for b in rows:
        if b.parent:
            p = at[b.parent]
            assert p.x < b.x and p.y < b.y and b.x + b.width < p.x + p.width and b.y + b.height < p.y + p.height
        for o in rows:
            if o.parent == b.parent and o.path > b.path:
                assert b.x + b.width <= o.x or o.x + o.width <= b.x or b.y + b.height <= o.y or o.y + o.height <= b.y
    assert layout(df.limit(0)).count() == 0
