import random

import pytest

from keyloom.llm import jaccard
from keyloom.llm.components import components
from tests.llm import brute


def corpus(seed: int, n: int) -> list[tuple[int, str]]:
    """Random documents, exact copies, near copies in chains, and passages many share."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    common = " ".join(r.choices(words, k=12))
    rows: list[tuple[int, str]] = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.2:
            text = r.choice(rows)[1]
        elif rows and kind < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w).upper() if r.random() < 0.3 else "  ".join(w)
        else:
            text = " ".join([common, *r.choices(words, k=r.randint(1, 60))])
        rows.append((i, text))
    return rows


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"n": 5, "num": 80, "den": 100}), (3, {"crowd": 0, "rest_factor": 0}), (4, {"broadcast_bytes": 0, "crowd": 0}), (5, {"rest_factor": 0, "work_per_task": 5})])
def test_equals_all_pairs(spark, seed, how):
    rows = corpus(seed, 70)
    full = {"n": 4, "num": 85, "den": 100}
    assert got(spark, rows, **how) == sorted(brute.components(rows, *({**full, **how}[k] for k in ("n", "num", "den"))), key=str)


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_heavy_centres_are_cut(spark, monkeypatch, most):
    """One centre with hundreds of partners, in parts of at most three pairs."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_TASK", 3)
    r = random.Random(8)
    text = [f"v{r.randrange(500)}" for _ in range(60)]
    rows = [(k, " ".join([*text[:20], f"x{k}", *text[20 + k % 12 :]])) for k in range(200)] + corpus(9, 40)[20:]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert got(spark, rows, broadcast_bytes=most) == sorted(brute.components(rows, 4, 85, 100), key=str)


def test_a_posting_with_thousands_of_unlike_members(spark):
    """Texts of a tiny vocabulary share nearly all their shingles with thousands of others, and few of them are similar."""
    r = random.Random(10)
    rows = [(k, " ".join(r.choices("abc", k=r.randint(4, 40)))) for k in range(2500)]
    sets = [frozenset(t[i : i + 7] for i in range(0, len(t) - 6, 2)) for _, t in rows]
    link = list(range(len(rows)))

    def root(i):
        while link[i] != i:
            i = link[i]
        return i

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            if 100 * len(sets[i]) < 85 * len(sets[j]):
                break
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                link[b] = a
    want = sorted([(k, len(sets[k]), root(k)) for k in range(len(rows))], key=str)
    assert got(spark, rows) == want and got(spark, rows, work_per_task=2000) == want


def test_filters_on_huge_sets(spark):
    n = 20_000_000
    rows = [(n, n, 1_000_000, 1_000_000, True), (n, n, 3_500_000, 0, False), (n, 16_900_000, 0, 0, False), (n, 17_100_000, 2_000_000, 0, True)]
    df = spark.createDataFrame(rows, "n bigint, c_n bigint, pos bigint, c_pos bigint, want boolean").selectExpr("*", f"{jaccard.could_match(85, 100)} AS got")
    assert all(r.got == r.want for r in df.collect()), df.collect()


def test_group_of_near_copies_is_one_component(spark):
    r = random.Random(5)
    text = [f"v{r.randrange(500)}" for _ in range(120)]
    rows = [(k, " ".join([*text[: k % 100], f"x{k}", *text[k % 100 + 1 :]])) for k in range(150)]
    assert got(spark, rows) == sorted(brute.components(rows, 4, 85, 100), key=str)


def test_edges(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "one two"), (5, "ONE\x0btwo"), (4, "one"), (3, "a b c d e"), (3, "a b c d e"), (2, "a b c d f"), (None, "one two"), (1, "é b c d"), (0, "É b c d")]
    assert got(spark, rows) == sorted(brute.components(rows, 4, 85, 100), key=str)
    assert got(spark, []) == []


def test_extra_columns_and_types(spark):
    df = spark.createDataFrame([("b", "x y z w", 1, "t"), ("a", "X Y Z W", 2, "u")], "doc_id string, text string, n int, component_id string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect()) == [("a", "a"), ("b", "a")]


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of words")]
    assert got(spark, rows) == [(1, 59997, 1), (2, 59998, 1), (3, 1, 3)]


def test_boundary_is_exact(spark):
    base = " ".join(f"w{k}" for k in range(103))  # 100 shingles of 4
    for shared, linked in ((92, True), (91, False)):  # 92 of 108 is 85.2 %, 91 of 109 is 83.5 %
        other = " ".join([*(f"w{k}" for k in range(shared + 3)), *(f"z{k}" for k in range(100 - shared))])
        assert (got(spark, [(1, base), (2, other)])[1][2] == 1) is linked


def test_components_of_a_chain_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(50, 50), (60, 61), (61, 60)]
    out = {(r.node, r.component) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {(k, 0) for k in range(41)} | {(60, 60), (61, 60)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
