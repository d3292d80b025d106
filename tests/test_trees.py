"""Trees of any depth, as-of parents and chapter sweeps against plain loops."""

import json
import random
import time

import pytest

from lectern.operators import chunking, tree

TOC = "book_id long, seq int, title string, number string, page int, level int, raw_text string"
HEADS = "book_id long, ord long, page int, text string, level int, num string, element_idx int, confidence double"
DEPTHS = [3, 6]


def contents(spark, books):
    return spark.createDataFrame([(b, i, f"t{i}", None if i % 3 else str(i), p, lv, "") for b, rows in books.items() for i, (lv, p) in enumerate(rows, 1)], TOC)


def some_books(depth, seed, n=60):
    r = random.Random(seed)
    return {b: [(r.randint(1, depth), page) for page in sorted(r.randint(1, 40) for _ in range(r.randint(1, 30)))] for b in range(n)}


@pytest.mark.parametrize("depth", DEPTHS)
def test_parents_ranges_and_json_of_any_depth(spark, depth):
    books = some_books(depth, depth)
    nodes = tree.from_contents(contents(spark, books), depth)
    total = spark.createDataFrame([(b, 50, 999) for b in books], "book_id long, total_pages int, last_idx int")
    filled = tree.fill_ranges(nodes, total, depth)
    got = {(r["book_id"], r["node_id"]): r for r in filled.collect()}
    want, nested = {}, {}
    for r in tree.nested(filled).collect():
        nested.setdefault(r["book_id"], []).append(r)
    for b, rows in books.items():
        stack, kids = [(0, 0, ())], {}
        for i, (lv, page) in enumerate(rows, 1):
            while stack[-1][1] >= lv:
                stack.pop()
            assert (got[b, i]["parent_id"], got[b, i]["path"]) == (stack[-1][0], [*stack[-1][2], i])
            kids.setdefault(stack[-1][0], []).append((page, i))
            stack.append((i, lv, (*stack[-1][2], i)))

        def fill(node, end, b=b, kids=kids):
            mine = sorted(kids.get(node, []))
            for (page, i), after in zip(mine, [*mine, None][1:], strict=True):
                want[b, i] = end if after is None else after[0] - 1
                fill(i, want[b, i] or 50)

        fill(0, 50)

        def nest(i, b=b, kids=kids, rows=rows):
            lv, page = rows[i - 1]
            out = {"title": f"t{i}", "level": lv, "start_page": page, "end_page": got[b, i]["end_page"], "children": [nest(k) for k in sorted(x for _, x in kids.get(i, []))]}
            return out if i % 3 else out | {"number": str(i)}

        wanted = {i: nest(i) for _, i in kids[0] if rows[i - 1][0] == 1}
        for r in nested.get(b, []):
            assert json.loads(r["json"]) == wanted.pop(r["node_id"])
        assert not wanted
    assert {k: r["end_page"] for k, r in got.items()} == want


def merged(books, heads, depth):
    """The agreed rule, heading by heading."""
    out = {}
    for b in {*books, *heads}:
        rows, stack = {}, [(0, 0, ())]
        for i, (lv, page) in enumerate(books.get(b, []), 1):
            while stack[-1][1] >= lv:
                stack.pop()
            rows[i] = [lv, page, (*stack[-1][2], i), None]
            stack.append((i, lv, rows[i][2]))
        pages = {}
        for i, (_, page, path, _) in rows.items():
            if page:
                pages[page] = max(pages.get(page, ((), 0)), (path, i))
        new = []
        for page, lv, element in heads.get(b, []):
            if page in pages:
                host = rows[pages[page][1]]
                host[3] = element if host[3] is None else host[3]
            else:
                new.append((page, lv, element))
        top = len(rows)
        for k, (page, lv, element) in enumerate(new, 1):
            near = [(page - p, path) for l, p, path, _ in rows.values() if l == lv - 1 and p and page and p <= page]
            up = min(near)[1] if near else ()
            rows[top + k] = [lv, page, (*up, top + k) if lv > 1 else (top + k,), element]
        out |= {(b, i): tuple(r) for i, r in rows.items()}
    return out


@pytest.mark.parametrize("depth", DEPTHS)
def test_headings_join_the_tree_as_of_their_page(spark, depth):
    r = random.Random(7 + depth)
    books = some_books(depth, 20 + depth, 50)
    books |= {b: [(lv, 0 if r.random() < 0.1 else p) for lv, p in rows] for b, rows in list(books.items())[:10]}
    heads = {}
    for b in range(5, 60):
        found = [(r.randint(1, 60), r.randint(1, depth), r.choice([None, r.randint(0, 99)])) for _ in range(r.randint(0, 25))]
        heads[b] = sorted(found, key=lambda h: (h[0], -h[1]))
    rows = [(b, i, p, "h", lv, None, e, 0.7) for b, found in heads.items() for i, (p, lv, e) in enumerate(found, 1)]
    got = tree.merge_headings(tree.from_contents(contents(spark, books), depth), spark.createDataFrame(rows, HEADS).repartition(3), depth).collect()
    assert {(x["book_id"], x["node_id"]): (x["level"], x["start_page"], tuple(x["path"]), x["start_idx"]) for x in got} == merged(books, heads, depth)
    assert all(x["parent_id"] == (x["path"][-2] if len(x["path"]) > 1 else 0) and x["seq"] == x["node_id"] for x in got)


def test_a_long_book_is_linear(spark):
    """A book of 200,000 headings takes seconds; all pairs of it would be 10^10."""
    heads = spark.range(200_000).selectExpr("1L as book_id", "id as ord", "cast(id div 3 + 2 as int) as page", "'h' as text", "cast(3 - id % 3 as int) as level", "cast(null as string) as num", "cast(id as int) as element_idx", "0.7D as confidence")
    began = time.time()
    out = tree.merge_headings(tree.from_contents(contents(spark, {1: [(1, 1)]})), heads)
    assert out.where("size(path) = 3").count() > 66_000 and time.time() - began < 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("legacy", [False, True])
def test_chapters_sweep_their_elements(spark, legacy):
    r = random.Random(3)
    elements = [(b, i, i // 4 + 1, r.choice(["x", " ", None, f"e{i}"])) for b in range(20) for i in range(r.randint(0, 60))]
    chapters = [(b, n, r.choice([None, r.randint(1, 15)]), r.choice([None, r.randint(-3, 60)]), r.choice([None, r.randint(-2, 70)])) for b in range(22) for n in range(r.randint(0, 6))]
    rows = chunking.chapter_texts(spark.createDataFrame(chapters, "book_id long, node_id int, start_page int, start_idx int, end_idx int"), spark.createDataFrame(elements, "book_id long, idx int, page int, text string"), legacy)
    want = {}
    for b, n, page, low, high in chapters:
        own = [(i, p, x) for k, i, p, x in elements if k == b]
        first = min((i for i, p, _ in own if p == page), default=None)
        low = low if low is not None else None if legacy else first
        parts = [x for i, _, x in own if max(low or 0, 0) <= i <= (high if high is not None else 10**9) and (x or "").strip()]
        if parts:
            want[b, n] = "\n\n".join(parts)
    assert {(x["book_id"], x["node_id"]): x["text"] for x in rows.collect()} == want
    pairs = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "stretch" in pairs


def test_windows_without_text(spark):
    rows = spark.createDataFrame([(1, ["x"] * 250), (2, [])], "book_id long, tokens array<string>")
    one, two = (chunking.windows(rows, ["book_id"], 100, 20, text=x) for x in (True, False))
    assert two.columns == ["book_id", "k", "token_start", "token_end"] and sorted(map(tuple, one.drop("text").collect())) == sorted(map(tuple, two.collect()))


def test_lines_of_contents_are_parsed_once(spark):
    """A condition on a parsed line isn't turned into a second parse, and stripping looks for no pattern."""
    from lectern.functions import text as t
    from lectern.operators import contents as c

    elements = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Contents", *(f" {i} Title{i} ..... {i} \t" for i in range(1, 9))])], "book_id long, idx int, text string")
    found = c.entries(elements)
    assert [(r["seq"], r["title"], r["page"]) for r in found.orderBy("seq").collect()] == [(i, f"Title{i}", i) for i in range(1, 9)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and 0 < plan.count("try_to_number") <= 5, plan.count("try_to_number")
    odd = spark.createDataFrame([(" \t\x0b\f\r\n a b  ",), ("",), (None,), (" x  ",), ("a \n",)], "x string")
    assert [r[0] for r in odd.select(t.strip(odd["x"])).collect()] == ["a b  ", "", None, " x ", "a"]
