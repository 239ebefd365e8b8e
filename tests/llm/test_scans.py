"""Secret scans, benchmark decontamination and token counts against plain versions."""

import hashlib
import random
import re
import string
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from keyloom.llm import decontaminate, secrets, wordpiece
from tests.llm import brute

KEY = "q9Zx7LmW2vRt5KpB8nYd3HsF"


def scan(spark, rows, **how):
    return secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), **how).collect()


def test_base_spans_equal_a_plain_reader(spark):
    r = random.Random(2)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "apikey", '"', "'", " ", "=", ":", "abc", "abcdef", "x" * 7, "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "f", "é", "\n", "-", "ſecret", "toKen"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(1, 14)))) for i in range(600)]
    for row in scan(spark, rows):
        spans = brute.base_secrets(rows[row.doc_id][1])
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for _, k, _ in spans) for kind in range(3)], rows[row.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_novelty(spark):
    near = f"client_session_identifier_2 = load('client_session_identifier_2')\nauth header: client_session_identifier_2\n"
    rows = [(1, f"auth: {KEY}"), (2, near), (3, f"no context {KEY}"), (4, f"{KEY} {KEY}\nbearer {KEY}"), (5, "key: " + "a1" * 30), (6, f"token = {KEY}")]
    out = {r.doc_id: r for r in scan(spark, rows)}
    assert out[1].spans == f"novel:6:{6 + len(KEY)}" and out[1].n_novel == 1
    assert [out[k].n_novel for k in (2, 3, 4, 5, 6)] == [0, 0, 0, 0, 0]  # known nearby, no context, repeated, compressible, a base span already
    assert out[6].n_assign == 1


@pytest.mark.parametrize("letters", ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_random_keys_of_all_lengths_are_novel(letters):
    r = random.Random(len(letters))
    for n in (20, 24, 32, 40, 48, 63, 64, 65, 96, 128, 200, 400, 800, 1200, 2000):
        for _ in range(10):
            key = "A1" + "".join(r.choices(letters, k=n - 2))
            for text in (f"key: {key}\n", f"key: {key}\nother words\nbearer {key} and auth: {key}\n", f"key: {key}\n{'x y ' * 400}\nauth: {key}\n", f"token = {key}\nauth: {key}\n"):
                spans = [(a, b) for a, _, b in secrets.find(text, True, True, 0.9)]
                at = [a for a in range(len(text)) if text.startswith(key, a)]
                assert all(any(s <= a and a + n <= e for s, e in spans) for a in at), (n, text)


READABLE = """billing_service_worker_pool_2 getUserAccountBalanceV2Request 2024-01-15-backup-rotation-policy /usr/local/share/applications/v2/index
com/example/project/module/Class3 release-candidate-build-2023-11 kubernetes-deployment-replicas-3 user_profile_image_thumbnail_256x256 mysql-primary-eu-west-1-instance-04
2024-06-30T12-45-59-export-report SessionTokenValidatorFactory2 the-quick-brown-fox-jumps-over-13-lazy-dogs MAX_CONNECTION_POOL_SIZE_1024 v1_feature_store_embedding_table
annual-report-fiscal-year-2023-final-v2 production-database-replica-07 HttpRequestHandlerFactoryV12 customer_invoice_total_2023_q4 s3/backup/bucket/region/2021-03-04
error_rate_threshold_percent_95 orders-service-2019-12-31-snapshot payment_gateway_timeout_seconds_30 nightly-build-2022-08-17-linux-x64 DefaultHttpClientConnectionPool4
application/json/v3/schema/user config_environment_production_v2 inventory-sync-worker-queue-12 email_template_password_reset_v5 docs/guides/getting-started-2
LegacyCustomerAddressMapper2 analytics-pipeline-stage-3-output frontend_bundle_hash_manifest_1 2018-07-04_2018-07-11_weekly_export""".split()


def test_random_keys_are_told_from_readable_names(spark):
    """Without training, 5 in 6 names are known to be readable; with a corpus that has their words, more. Random keys are found all the same."""
    r = random.Random(3)
    vocabulary = sorted({w.lower() for name in READABLE for w in re.findall(r"[A-Za-z][a-z]{3,}", name)})
    docs = spark.createDataFrame([(i, " ".join(r.choices(vocabulary, k=60))) for i in range(300)], "doc_id bigint, text string")
    trained = secrets.train(docs)
    assert len(trained) > 60 and trained == secrets.train(docs.repartition(5)) and secrets.train(docs.limit(0)) == ()
    around = "auth settings of the service follow. " * 8
    for words, most in (((), 6), (trained, 2)):
        novelty, found = secrets.Novelty(words), 0
        names = [x for x in READABLE if secrets.find(f"{around}key: {x}\n", True, True, 0.9, novelty)]
        assert len(names) <= most, names
        for k in range(1000):
            letters = string.ascii_letters + string.digits + "+/" if k % 2 else string.digits + string.ascii_uppercase[: r.choice([6, 26])]
            key = "A1" + "".join(r.choices(letters, k=r.randint(18, 90)))
            found += bool(secrets.find(f"{around}key: {key}\n", False, True, 0.9, novelty))
        assert found >= 990, found


def test_values_of_assignments_and_words_between(spark):
    lead = ["PRIVATE_KEY=", "auth=", "export SESSION_SALT=", "https://a.example/?x=1&signature=", "--auth-key=", "auth header value: ", "signing_key_id = '", "key:", "cookie: id=", "key" + "." * 40]
    pad = ["", "=", "==", "'", "\n", "&next=1"]
    rows = [(100 * i + j, f"{x}{KEY}{y}") for i, x in enumerate(lead) for j, y in enumerate(pad)]
    rows += [(5001, "key" + "." * 41 + KEY), (5002, f"key\n{KEY}"), (5003, f"{KEY}=1 key"), (5004, f"id={KEY}")]
    out = {r.doc_id: r for r in scan(spark, rows, mark="[S]")}
    for i, text in rows:
        if i < 5000:
            at = text.index(KEY)
            (a, b) = map(int, out[i].spans.split(":")[1:])
            assert out[i].n_novel == 1 and a <= at and at + len(KEY) <= b and KEY not in out[i].redacted, text
            assert text[:at].endswith(text[a:at]) and (a == at or text.startswith("cookie")), text
        else:
            assert out[i].n_novel == 0 and out[i].redacted == text, text
    two = f"auth: {KEY}=={KEY[::-1]}=="
    assert KEY not in secrets.redacted(two, secrets.find(two, True, True, 0.9), "[S]") and KEY[::-1] not in secrets.redacted(two, secrets.find(two, True, True, 0.9), "[S]")


def test_secret_edges_and_redaction(spark):
    rows = [(None, None), (1, ""), (2, "password = hunter22 and é token:abcdefg"), (2, "password = hunter22 and é token:abcdefg"), (3, "x" * 3_000_000 + " secret=abcdef")]
    out = scan(spark, rows, mark="[S]")
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in out}
    assert len(out) == 5 and by[None].base_sha256 == by[1].base_sha256 == empty and by[None].spans == "" and by[None].redacted is None and by[1].redacted == ""
    assert by[2].redacted == "[S] and é [S]" and by[2].spans == "assign:0:19,assign:26:39"
    assert by[3].redacted == "x" * 3_000_000 + " [S]"
    assert scan(spark, []) == []


def test_secret_scan_passes_columns_on(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "u", 5)], "doc_id bigint, text string, spans string, n_hex int")
    out = secrets.scan(df.withColumnRenamed("spans", "other").withColumnRenamed("n_hex", "k0"), keep=("other", "k0")).collect()[0]
    assert (out.other, out.k0, out.n_assign) == ("u", 5, 1)
    (clash,) = secrets.scan(df, keep=("spans", "n_hex")).collect()
    assert (clash.spans, clash.n_hex) == ("assign:0:14", 0)


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {r.doc_id: r for r in decontaminate.scan(d, spark.createDataFrame(items, "item_id bigint, text string"), **how).collect()}


@pytest.mark.parametrize("how", [{}, {"block_words": 40}, {"window": 3}])
def test_decontamination_equals_a_plain_search(spark, how):
    r = random.Random(4)
    words = ["alpha", "Beta", "γάμμα", "d4", "eps", "zeta"]
    items = [(k, " ".join(r.choices(words, k=r.choice([0, 1, 2, 5, 13, 14, 20])))) for k in range(1, 14)] + [(20, None), (21, "!!"), (None, "alpha beta alpha")]
    docs = []
    for i in range(60):
        w = r.choices(words, k=r.randint(0, 60))
        if r.random() < 0.7:
            at, (_, item) = r.randint(0, len(w)), r.choice(items[:13])
            w[at:at] = item.replace(" ", r.choice([" ", "-", ", "])).split(" ")
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "..."), (103, " ".join(["filler"] * 900 + (items[5][1] or "").split()))]
    out = found(spark, docs, items, **how)
    known = [x for x in items if x[0] is not None]
    for i, text in docs:
        n, hit, ids, bad = brute.contamination(text, known, how.get("window", 13))
        row = out[i]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated, list(row["items"])) == (n, hit, len(ids), bad, ids), (i, text)
        assert row.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_decontamination_edges(spark):
    item = " ".join(f"q{k}" for k in range(15))
    docs = [(1, item), (1, item), (2, f"{item} " + "w " * 285), (3, f"{item} " + "w " * 286), (4, " ".join(item.split()[:12]))]
    out = found(spark, docs, [(5, item), (5, item), (12, item)])
    assert [out[k].contaminated for k in (1, 2, 3, 4)] == [True, True, False, False]  # 15 of 300 words is a twentieth
    assert list(out[2]["items"]) == ["12", "5"] and [(s.start, s.end) for s in out[2].spans] == [(0, 15)]
    assert not any(r.contaminated for r in found(spark, docs, []).values()) and found(spark, [], [(1, item)]) == {}
    kept = decontaminate.scan(spark.createDataFrame([(1, item, 3)], "doc_id bigint, text string, k0 int"), spark.createDataFrame([(1, item)], "item_id bigint, text string"), keep=("text", "k0")).collect()[0]
    assert (kept.text, kept.k0) == (item, 3)


def test_decontamination_compares_bytes(spark, monkeypatch):
    """With a hash that confuses words of one length, the windows are still told apart by their bytes."""
    monkeypatch.setattr(decontaminate.textops, "word_hashes", lambda buf, a, b: (b - a).astype(np.uint64))
    table = decontaminate.Table([("1", "aa bb cc"), ("2", "aa bb dd"), ("3", "aa bb cc dd")], 3)
    docs = decontaminate.Words(pa.array(["xx AA bb cc yy", "aa bb ee", None, "aa-bb-dd"], pa.large_string()))
    hit, items = decontaminate.hits(docs, table)
    assert hit.tolist() == [False, True, True, True, False, False, False, False, True, True, True] and items == [{"1", "3"}, set(), set(), {"2"}]


def test_decontamination_in_many_blocks_equals_one(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(words, k=r.randint(1, 40)))) for k in range(400)] + [(k, " ".join(words[:30])) for k in range(400, 440)]
    docs = [(i, " ".join(r.choices(words, k=50) + r.choice(items)[1].split() + r.choices(words, k=r.randint(0, 500)))) for i in range(100)] * 2 + [(900, None), (None, items[3][1])]
    docs += [(901, " ".join(r.choices(words, k=400_000) + items[5][1].split()))]
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, h1 int"), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (sorted((tuple(str(x) for x in r) for r in decontaminate.scan(d, b, keep=("h1",), **how).collect())) for how in ({}, {"block_words": 500}))
    assert one == many and len(one) == len(docs)


def test_wu_manber_across_lanes():
    r = np.random.default_rng(1)
    h = r.integers(0, 3, 5000).astype(np.uint64)
    grid = np.unique(np.lib.stride_tricks.sliding_window_view(h, 5)[r.integers(0, 4990, 30)], axis=0)
    items = grid.reshape(-1)
    p = decontaminate.Patterns(items, 5, np.arange(len(grid)) * 5, np.arange(len(grid) + 1), np.arange(len(grid)))
    end, row = p.find(h, items)
    got = sorted((int(e), tuple(items[p.where[k] : p.where[k] + 5])) for e, k in zip(end, row, strict=True))
    known = {tuple(x) for x in grid}
    assert got == sorted((i + 4, tuple(h[i : i + 5])) for i in range(len(h) - 4) if tuple(h[i : i + 5]) in known)


@pytest.fixture(scope="module")
def vocab():
    return wordpiece.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_greedy_matching(spark, vocab):
    r = random.Random(8)
    bits = ["un", "believ", "able", "ing", "é", "語", "👍", "xqz", "0", "12345", "THE", "the", "\x00", "#", "aaaaaaaa"]
    rows = [(i, " ".join("".join(r.choices(bits, k=r.randint(1, 5))) for _ in range(r.randint(0, 20)))) for i in range(120)] + [(500, None), (501, ""), (502, "\t \n"), (503, "ab" * 50_000), (503, "ab" * 50_000)]
    out = wordpiece.counts(spark.createDataFrame([(*x, "c") for x in rows], "doc_id bigint, text string, n_tokens string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(out) == len(rows)
    for row in out:
        text = dict(rows)[row.doc_id]
        if row.doc_id == 503:
            assert row.n_words == 1 and row.n_tokens == row.longest > 10_000
            continue
        pieces = [brute.greedy_pieces(w.encode(), *vocab) for w in brute.SPACE_WORDS.findall(text or "")]
        assert (row.n_words, row.n_tokens, row.longest) == (len(pieces), sum(pieces), max(pieces, default=0))


def test_automaton_on_a_small_vocabulary():
    letters = {bytes([b]) for b in range(256)}
    starts, rest = letters | {b"ab", b"abcde", b"bc"}, letters | {b"cd", b"cdx", b"de", b"dede"}
    auto = wordpiece.build(starts, rest)
    r = random.Random(1)
    words = [bytes(r.choices(b"abcdex", k=r.randint(1, 12))) for _ in range(3000)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    out = auto.lengths(buf, ends - [len(w) for w in words], ends)
    assert out.tolist() == [brute.greedy_pieces(w, starts, rest) for w in words]


def test_long_words(vocab):
    auto = wordpiece.build(*vocab)
    r = random.Random(2)
    words = ["".join(r.choices(string.ascii_letters + string.digits, k=n)).encode() for n in (100_000, 60_000, 3)] + [b"ab" * 50_000, "語".encode() * 30_000]
    words += ["".join(r.choices("theand", k=r.randint(1, 40))).encode() for _ in range(200)]  # lanes enough for steps in numpy first
    words = words[:-10] + [b"x" * 20_000] + words[-10:]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start, rest = vocab
    most = max(map(len, start | rest))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += max(k for k in range(1, min(most, len(word) - at) + 1) if word[at : at + k] in (rest if at else start))
            n += 1
        return n

    assert auto.lengths(buf, ends - [len(w) for w in words], ends).tolist() == [greedy(w) for w in words]
    long = np.frombuffer("".join(r.choices(string.ascii_letters + "+/", k=10_000_000)).encode(), np.uint8)
    began = time.perf_counter()
    assert auto.lengths(long, np.array([0]), np.array([len(long)]))[0] > 1_000_000
    assert time.perf_counter() - began < 60
