import random

import pytest

from gleanery.llm import splitting as S

SCHEMA = "doc_id string, text string, sections array<struct<section_name:string,section_order:int,char_start:int,char_end:int>>, doc_tables array<struct<grid:array<array<string>>,caption:string,char_start:int,char_end:int>>, item_no int"


def pieces(spark, rows, **knobs):
    out = {}
    for r in S.pieces(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), **knobs).collect():
        out.setdefault((r.doc_id, r.item_kind, r.item_no), []).append((r.piece_no, r.char_start, r.char_end))
    return {k: sorted(v) for k, v in out.items()}


def walk(b, limit, overlap):
    """Greedy cuts, one after the other."""
    at, out = 0, []
    while True:
        end = max(k for k in range(len(b)) if b[k] <= b[at] + limit)
        out.append((b[at], b[end]))
        if end == len(b) - 1:
            return out
        at = min(k for k in range(len(b)) if k > at and b[k] >= b[end] - overlap and b[k] + limit >= b[end + 1])


@pytest.mark.parametrize("seed", range(8))
def test_doubling_gives_the_greedy_cuts(seed):
    rng = random.Random(seed)
    items = []
    for _ in range(20):
        cuts = [0]
        for _ in range(rng.randint(0, 60)):
            cuts.append(cuts[-1] + rng.randint(1, 50))
        items.append(S.np.array(cuts))
    item, number, start, end = S.all_pieces(items, 50, 20)
    for k, cuts in enumerate(items):
        got = [(int(a), int(b)) for i, a, b in zip(item, start, end) if i == k]
        assert got == (walk(cuts.tolist(), 50, 20) if len(cuts) > 1 else [])
    assert all(n == 0 or i == j for n, i, j in zip(number[1:], item[1:], item[:-1]))


def prose(rng, n):
    return "\n\n".join(" ".join("word " * rng.randint(3, 20) + "end." for _ in range(rng.randint(1, 6))) for _ in range(n))


def check(text, spans, limit, overlap, start=0, end=None):
    end = len(text) if end is None else end
    assert spans[0][1] == start and spans[-1][2] == end
    for (n, a, b), (m, c, d) in zip(spans, spans[1:]):
        assert m == n + 1 and a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for _, a, b in spans)


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(2)
    text = prose(rng, 40)
    half = text.index("\n\n", len(text) // 2) + 2
    got = pieces(spark, [("a", text, [("s", 0, 0, half), ("t", 1, half, len(text))], [(None, None, 10, 40)])])
    assert set(got) == {("a", "document", 0), ("a", "section", 0), ("a", "section", 1), ("a", "table", 0)}
    check(text, got["a", "document", 0], 2000, 200)
    check(text, got["a", "section", 1], 2000, 200, half)
    for spans in got.values():
        for _, _, b in spans[:-1]:
            assert text[:b].endswith((" ", "\n"))


def test_texts_without_boundaries(spark):
    for text in ("x" * 9_999, "word " * 2_000, "x" * 2_001):
        got = pieces(spark, [("a", text, None, None)])["a", "document", 0]
        check(text, got, 2000, 200)
        assert all(b - c > 0 for (_, _, b), (_, c, _) in zip(got, got[1:]))


def test_cases(spark):
    rows = [("n", None, None, None), ("e", "", [], []), ("s", "short", [("s", 3, 0, 99), ("r", 4, 4, 2), None], [None, (None, None, None, 3)]), ("l", "x" * 2000, None, None)]
    got = pieces(spark, rows)
    assert got == {("s", "document", 0): [(0, 0, 5)], ("s", "section", 3): [(0, 0, 5)], ("l", "document", 0): [(0, 0, 2000)]}


def test_empty_table(spark):
    assert pieces(spark, []) == {}


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        pieces(spark, [], limit=10, overlap=10)
