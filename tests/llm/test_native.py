"""Preference formatting and the URL filter: DataFrame expressions against plain Python."""

import hashlib
import math
import random
from collections import Counter

import pytest

from keyloom.llm import preference, urls
from keyloom.llm.queries import RULES


def plans_have_no_python(df) -> bool:
    return not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def render(turns):
    text, spans = "", []
    for role, body in turns:
        text += f"<|{role.replace('<|', '< |')}|>\n"
        a = len(text)
        text += body.replace("<|", "< |") + preference.END
        if role == "assistant":
            spans.append((a, len(text)))
        text += "\n"
    return text, spans


def test_pairs_equal_plain_formatting(spark):
    r = random.Random(5)
    texts = ["hi", "", "<|end|> é", "語 👍", "ok\nthen"]
    pairs = []
    for i in range(200):
        common = [(r.choice(["user", "assistant", "system"]), r.choice(texts)) for _ in range(r.randint(0, 4))]
        tail = [[(r.choice(["user", "assistant"]), r.choice(texts)) for _ in range(r.randint(0, 3))] for _ in range(2)]
        pairs.append((i, common + tail[0], common + tail[1]))
    turns = lambda x: [(k, *t) for k, t in enumerate(x)]
    df = spark.createDataFrame([(i, turns(a), turns(b)) for i, a, b in pairs], f"id bigint, chosen {preference.TURN}, rejected {preference.TURN}")
    out = preference.format_pairs(df)
    assert plans_have_no_python(out.select("*").where("prompt_turns >= 0").groupBy("prompt").count())
    for row in out.collect():
        _, a, b = pairs[row.id]
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        assert row.prompt_turns == k and row.prompt == render(a[:k])[0]
        for side, rest, spans in ((row.chosen, a[k:], row.chosen_spans), (row.rejected, b[k:], row.rejected_spans)):
            assert (side, [tuple(s) for s in spans]) == render(rest)


def test_preference_edges(spark):
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"), (2, None, None, None, "x"), (None, 1, "user", "q", "x")]
    talks = preference.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id string"))
    by = {r.id: [(t.turn, t.role, t.text) for t in r.turns] for r in talks.collect()}
    assert by == {1: [(1, "user", "a"), (1, "user", "a"), (2, "assistant", "b")], 2: [(None, "", "")], None: [(1, "user", "q")]}
    both = preference.paired(talks.where("id = 1"), talks.where("id = 2"))
    out = {r.id: r for r in preference.format_pairs(both).collect()}
    assert out[1].prompt == "" and out[1].rejected == "" and "b<|end|>" in out[1].chosen and out[2].chosen == ""
    same = preference.format_pairs(talks.select("id", "turns", talks.turns.alias("chosen"), talks.turns.alias("rejected")).drop("turns")).where("id = 1").first()
    assert (same.prompt_turns, same.chosen, same.rejected) == (3, "", "")
    assert preference.format_pairs(both.limit(0)).collect() == [] and preference.conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_long_conversation(spark):
    df = spark.range(5000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    talks = preference.conversations(df)
    out = preference.format_pairs(talks.select("id", talks.turns.alias("chosen"), preference.stale_reply(talks.turns).alias("rejected"))).first()
    assert out.prompt_turns == 4999 and "t4999" in out.chosen and "t4997" in out.rejected and len(out.chosen_spans) == 1


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:k], rest[k:]
    k = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:k]


def ruled(host, path):
    best = None
    for v, r in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = v, r
    return best or (None, None)


def plain_ratio(train, strings):
    """Witten-Bell trigram models of two sets of strings; the mean log ratio in millionths of each string."""
    size, models = len(urls.SYMBOLS) + 2, []
    every = {s[i : i + 3] for s in strings for i in range(len(s) - 2)}
    for side in ("allow", "block"):
        tri = Counter(s[i : i + 3] for v, s in train if v == side for i in range(len(s) - 2))
        bi, uni = Counter(), Counter()
        for g, n in tri.items():
            bi[g[1:]] += n
            uni[g[2]] += n
        total = sum(uni.values())
        models.append((tri, bi, uni, total))

    def p(m, g):
        tri, bi, uni, total = m
        p0 = (uni[g[2]] + 1) / (total + size)
        n1, t1 = sum(n for x, n in bi.items() if x[0] == g[1]), sum(x[0] == g[1] for x in bi)
        p1 = (bi[g[1:]] + t1 * p0) / (n1 + t1) if n1 else p0
        n2, t2 = sum(n for x, n in tri.items() if x[:2] == g[:2]), sum(x[:2] == g[:2] for x in tri)
        return (tri[g] + t2 * p1) / (n2 + t2) if n2 else p1

    value = {g: round((math.log(p(models[0], g)) - math.log(p(models[1], g))) * 1_000_000) for g in every}
    return [math.floor(sum(value[s[i : i + 3]] for i in range(len(s) - 2)) / (len(s) - 2)) for s in strings]


def test_urls_equal_plain_models(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        host = r.choice(["example.com", "a.Example.COM", "x.net", "example.net", "good.org", "b.dev", "com"])
        path = r.choice(["/en/7", "/en/8", "/de/8x", "/de/", "/es/1", "/fr/éa?q=1", "", "/EN/7#f", "/a/b//c"])
        rows.append((i, r.choice(["http://", "https://", "ftp://", ""]) + host + path))
    rows += [(500, None), (501, ""), (502, "no-scheme/x"), (503, "a://"), (504, "http://x.com/en/://y"), (505, "http://" + "k" * 20_000), (500, None)]
    out = sorted(urls.judge(spark.createDataFrame([(*x, "c") for x in rows], "page_id bigint, url string, host string"), RULES).collect(), key=lambda x: x.page_id)
    assert len(out) == len(rows)
    spell = lambda h, p: "^^" + "".join(c if c in urls.SYMBOLS else "*" for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in h + p)) + "$"
    known = {i: split(u) for i, u in rows}
    cases = [(ruled(*known[r.page_id])[0], spell(*known[r.page_id])) for r in out]
    held = [hashlib.md5("".join(known[r.page_id]).encode()).hexdigest()[0] < "4" for r in out]
    ratios = plain_ratio([x for x, h in zip(cases, held, strict=True) if not h], [s for _, s in cases])
    marked = [(v, x) for (v, _), x, h in zip(cases, ratios, held, strict=True) if v and h]
    n = Counter(v for v, _ in marked)
    gain = lambda b: sum((x // urls.STEP < b) * (n["allow"] if v == "block" else -n["block"]) for v, x in marked)
    assert len(n) == 2
    limit = max(sorted({x // urls.STEP for _, x in marked}), key=lambda b: (gain(b), -b)) * urls.STEP
    for row, (verdict, _), ratio in zip(out, cases, ratios, strict=True):
        assert (row.host, row.path) == known[row.page_id] and row.rule == ruled(*known[row.page_id])[1]
        assert row.verdict == (verdict or ("allow" if ratio >= limit else "block"))
        assert row.ratio is None if verdict else abs(row.ratio - ratio) <= 1


def test_url_edges(spark):
    df = spark.createDataFrame([(1, "http://x.org/a"), (2, None)], "page_id bigint, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in urls.judge(df, RULES).collect()} == {(1, None, "allow"), (2, None, "allow")}
    assert urls.judge(df.limit(0), RULES).collect() == []
    assert plans_have_no_python(urls.judge(df, RULES))


def test_many_rules_and_hostile_urls(spark):
    r = random.Random(1)
    rules = [(r.choice(["allow", "block"]), f"{'sub.' * r.randint(0, 2)}h{r.randint(0, 80)}.com/{r.choice(['', 'a', 'a/b', 'en/'])}") for _ in range(700)]
    rows = [(i, f"http://{'x.' * r.randint(0, 1)}{'sub.' * r.randint(0, 3)}h{r.randint(0, 99)}.com/{r.choice(['', 'a/b/c', 'en/1', 'b'])}") for i in range(300)]
    rows += [(400, None), (401, ""), (402, "http://"), (403, rows[0][1]), (404, "http://" + "a." * 2000 + "h1.com/" + "en/" * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    many = sorted((x.page_id, x.rule, x.verdict, x.ratio) for x in urls.judge(df, rules).collect())
    for page, rule, verdict, _ in many:
        host, path = split(dict(rows)[page])
        fits = [(len(x), x, i, v) for i, (v, x) in enumerate(rules) if (host == (h := x.partition("/")[0]) or host.endswith(f".{h}")) and path.startswith("/" + x.partition("/")[2])]
        assert rule == (max(fits)[1] if fits else None) and (not fits or verdict == max(fits)[3])
    assert len(many) == len(rows) and len({x[1] for x in many}) > 50
    assert plans_have_no_python(urls.judge(df, rules))
