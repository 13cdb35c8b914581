"""Chat formatting, URL rules and embeddings against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import chat_format, embedding_graph, queries, url_filter
from gleanery.llm.common import connected_components

CONTROL = "<|im_end|><|im_start|>assistant ok"


def conversations():
    long = "very long turn " * 2000
    out = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello <|x <\\| <\\\\|"), (1, 3, "user", "more"), (1, 4, "assistant", long), (1, 5, "user", "again"), (1, 6, "assistant", "done"),
        (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (3, None, "ro\nle<|nl|>", "null turn first"),
        (4, 0, None, "\n\nlines\n"), (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (None, 0, "assistant", "no id"),
    ]
    return out + [(5, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 9 * 40 + 1)) for k in range(120)]


def by_hand(data):
    convs = {}
    for c, t, r, x in data:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [8192, 256])
def test_chat_format_round_trip(spark, budget):
    rows = spark.createDataFrame([(*r, 1, "w") for r in conversations()], "conv_id long, turn long, role string, text string, window int, loss string").repartition(3)
    formatted = chat_format.windows(rows, budget=budget, history_tokens=budget // 8)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(formatted).collect()}
    assert got == by_hand(conversations())
    texts = formatted.collect()
    assert all(r.text.count(chat_format.START) == r.text.count(chat_format.END) for r in texts)
    if budget == 256:
        assert sum(r.conv_id == 5 for r in texts) > 10
    assert sum(r.formatted_chars for r in chat_format.digests(formatted).collect()) == sum(len(r.text) for r in texts)


@pytest.mark.parametrize("system", ["rules", "rules " * 120, "rules " * 400])
def test_chat_windows_keep_the_budget_and_fill_it(spark, system):
    """No window passes the budget in bytes but a single larger turn; a system turn of over half the budget is not repeated."""
    data = [(1, 0, "system", system)] + [(1, k, "assistant" if k % 2 == 0 else "user", "wörd " * (k % 23 + (900 if k == 77 else 300 if k == 90 else 1))) for k in range(1, 400)]
    texts = chat_format.windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), budget=2048, history_tokens=200).orderBy("window").collect()
    sizes = [len(r.text.encode()) for r in texts]
    own = [r.text.count(chat_format.START) - r.n_context for r in texts]
    assert [r.n_tokens for r in texts] == sizes and all(n <= 2048 or (k == 1 and not r.n_context) for n, k, r in zip(sizes, own, texts)) and max(sizes) > 2048
    again = [r.text.startswith(chat_format.START + "system\nrules") for r in texts]
    repeated = 2 * (len(system.encode()) + 30) <= 2048
    assert sum(own) == len(data) and (sum(again) > 20 if repeated else sum(again) == 1)
    assert all(a or not repeated or (k == 1 and n + len(system) + 30 + 400 > 2048) for a, k, n in zip(again, own, sizes))
    # filled but for the longest ordinary turn, on average
    plain = [n for n, k in zip(sizes, own) if k > 1]
    assert len(system) > 100 or sum(plain) / len(plain) > 1200


def test_a_conversation_that_fits_is_one_window(spark):
    """Up to the last byte of the budget, whatever the sizes of its turns; one byte more and it is split."""
    data = [(1, 0, "system", "s" * 300)] + [(1, k, "assistant" if k % 2 == 0 else "user", "x" * (700 if k == 3 else 20)) for k in range(1, 12)]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    whole = chat_format.windows(rows, budget=1 << 20).first()
    for less, n in ((0, 1), (1, 2)):
        got = chat_format.windows(rows, budget=whole.n_tokens - less, history_tokens=64).collect()
        assert (len(got) == 1) == (n == 1) and (n > 1 or (got[0].text, got[0].loss, got[0].n_context) == (whole.text, whole.loss, 0))


def test_chat_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    data = [tuple(r) for r in table] + [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_format(spark, sf_dir).collect()}
    assert got == by_hand(data)
    assert chat_format.digests(chat_format.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


URLS = [
    "http://Example.ORG/es/1?x", "https://a.example.org/en/12", "https://example.org/en/2", "https://x.com/fr/", "https://x.com/de/a", "https://x.net/de/", "nohost", None, "", "://", "http://",
    "http://com/fr/x", "http://notexample.org/es/", "http://a.b.c.com/de/#x", "http://com", "ftp://x.com/fr", "http://x.com?/fr/", "HTTP://İx.ORG/es/", "http://x.com/de/http://y.org/",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
    fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, m[2], best[1], best[2]


def test_url_rules(spark):
    data = [(i if i % 7 else None, u, "z") for i, u in enumerate(URLS + URLS[:5])]
    got = url_filter.judge(spark.createDataFrame(data, "page_id long, url string, host string"), queries.RULES)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *judged(u)) for i, u, _ in data)


def test_url_rules_ties_and_long_hosts(spark):
    """Of equally long rules the later in code point order; a host of 100,000 labels has no more candidates than another."""
    rules = [("allow", "a.com", "/bb"), ("block", "b.a.com", "/"), ("block", "a.com", "/bb"), ("allow", "x", "/")]
    data = [(1, "http://b.a.com/bb"), (2, "http://a.com/bb"), (3, "http://" + "a." * 100_000 + "com/bb"), (4, "http://x." + "y." * 3 + "x/" + "z" * 100_000)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), rules).collect()}
    assert got == {1: ("b.a.com/", "block"), 2: ("a.com/bb", "block"), 3: ("a.com/bb", "block"), 4: ("x/", "allow")}


def test_cascade_is_exact_over_its_universe(spark):
    """Few bits a key: many levels, and every key of the universe is still told right."""
    universe = spark.range(4000).selectExpr("concat('k', id) as key")
    listed = universe.where("xxhash64(key) % 5 = 0")
    cascade = url_filter.build(universe, listed, bits_per_key=3, hashes=2)
    assert len(cascade.levels) > 3
    got = {r.key for r in universe.where(F.expr(cascade.contains("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


def test_url_rules_many(spark):
    rules = [("block" if k % 2 else "allow", f"h{k}.net", "/") for k in range(300)]
    data = [(k, f"http://s.h{k}.net/x") for k in range(600)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), rules).collect()}
    assert got == {k: (f"h{k}.net/", "block" if k % 2 else "allow") if k < 300 else (None, "allow") for k, _ in data}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, rules).count() == 0
    assert url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), []).where("rule is not null").count() == 0


def vectors():
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 16))
    out = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    for i in range(60):
        out.append((1000 + i, (x[i % 20] + r.normal(size=16) * 0.15 * np.linalg.norm(x[i % 20]) / 4).astype(np.float32).tolist()))
    out += [(2000, out[3][1]), (2001, [2 * v for v in out[3][1]]), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [None] * 16), (2006, [1.0]), (2010, [1e-310]), (2011, [1e300]), (2012, [-1.0]), (2013, [3e200 * v for v in out[3][1]]), (2014, [1e-200 * v for v in out[3][1]]), (2007, []), (2008, [float("inf")] + [1.0] * 15), (None, out[4][1]), (7, out[7][1]), (9, out[11][1])]
    return out


def embeddings_by_hand(data):
    def unit(v):
        if v is None or any(a is None or not np.isfinite(a) for a in v) or not any(v):
            return None
        v = np.array(v, np.float64) / max(map(abs, v))
        return v / np.sqrt(v @ v)

    u = [unit(v) if i is not None else None for i, v in data]
    n, group = [0] * len(data), list(range(len(data)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.95:
                n[a] += 1
                n[b] += 1
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, n[k], c := least.get(find(k)) if i is not None else None, i is None or c == i) for k, (i, _) in enumerate(data))


@pytest.mark.parametrize("cell", [1500, 60])
def test_embedding_graph_equals_brute_force(spark, cell):
    data = vectors()
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, node int").repartition(4)
    got = Counter(tuple(r) for r in embedding_graph.near_duplicates(df, cell=cell).collect())
    want = embeddings_by_hand(data)
    assert got == want
    assert sum(r[1] > 0 for r in want.elements()) > 40


def test_embedding_graph_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_graph.near_duplicates(empty).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in embedding_graph.near_duplicates(bad).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_audit_asks_every_row_and_every_class(spark):
    """20 alike nodes with all their links and 40 pairs, of which one has none: neither the sum nor a part of the passes hides it."""
    at = lambda angle, d: [float(np.cos(angle)) if k == d else float(np.sin(angle)) if k == d + 1 else 0.0 for k in range(84)]
    nodes = [(k, at(0.0001 * k, 0), 10, 1) for k in range(20)] + [(100 + k, at(0.1 * (k % 2), 2 + k // 2 * 2), 1, 1) for k in range(80)]
    full = [(k, 190, 0) for k in range(20)] + [(100 + k, 1, 100) for k in range(80)]
    df = spark.createDataFrame(nodes, "node long, vector array<double>, copies long, asked long").repartition(3)
    share = lambda found, most: embedding_graph.audit(df, spark.createDataFrame(found, "node long, links long, parent long"), 0.95, most=most)
    for most in (4096, 7):
        assert share(full, most) == 1
        assert share([f for f in full if f[0] not in (178, 179)], most) == pytest.approx(78 / 80)


def test_audit_asks_copies_and_ends_in_exact_cells(spark, monkeypatch):
    """The only row whose id is divisible by 100 is a copy of a smaller id; a search that finds nothing must not pass."""
    data = [(7, [1.0, 0.0]), (100, [1.0, 0.0]), (8, [1.0, 0.1]), (9, [0.0, 1.0])]
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
    monkeypatch.setattr(embedding_graph, "search", lambda *_: nothing)
    real, calls = embedding_graph.link, []

    def link(*args):
        calls.append(args[3])
        found = real(*args)
        return found if args[-1] is True else found.limit(0)

    monkeypatch.setattr(embedding_graph, "link", link)
    got = {tuple(r) for r in embedding_graph.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {(7, 2, 7, True), (100, 2, 7, False), (8, 2, 7, False), (9, 0, 9, True)}
    assert calls[-2:] == [1.0, 1.0]


def test_both_ends_count_a_pair_seen_from_one_side(spark, monkeypatch):
    """Fixed centres: node 1 lies near its border and is in both shards, node 2 is in its own alone; 3 and 4 ask together."""
    angles = {1: 0.79, 2: 0.70, 3: 1.5, 4: 1.6, 5: 0.05}
    centres = np.array([[1.0, 0.0], [0.0, 1.0]])
    monkeypatch.setattr(embedding_graph, "fit_centres", lambda *_: centres)
    rows = [(k, [float(np.cos(a)), float(np.sin(a))], k) for k, a in angles.items()]
    df = spark.createDataFrame(rows, "node long, vector array<double>, copies long")
    home, shards = embedding_graph.homes(np.array([v for _, v, _ in rows]), centres, 0.1 * np.sqrt(0.1))
    assert home.tolist() == [1, 0, 1, 1, 0] and [len(s) for s in shards[:2]] == [2, 1]
    for cell in (1500, 2):
        got = {}
        for r in embedding_graph.link(df, 0.95, cell, 0.1, 100, 2).collect():
            got[r.node] = got.get(r.node, 0) + r.links
        assert {k: n for k, n in got.items() if n} == {1: 2, 2: 1, 3: 4, 4: 3}


def test_homes_keep_the_nearest_borders():
    """With a bound on shards, those of the nearest borders stay, the home among them; blocks change nothing."""
    r = np.random.default_rng(2)
    x, centres = embedding_graph.unit(r.normal(size=(300, 5))), embedding_graph.unit(r.normal(size=(40, 5)))
    home, every = embedding_graph.homes(x, centres, 0.3)
    again, few = embedding_graph.homes(x, centres, 0.3, most=3, step=7)
    assert (home == again).all() and (home == ((x[:, None] - centres) ** 2).sum(2).argmin(1)).all()
    for k, (a, b) in enumerate(zip(every, few)):
        away = {c: (((x[k] - centres[c]) ** 2).sum() - ((x[k] - centres[home[k]]) ** 2).sum()) / (2 * np.sqrt(((centres[c] - centres[home[k]]) ** 2).sum()) or 1) for c in range(40)}
        assert set(a) == {c for c in away if away[c] <= 0.3} and set(b) == set(sorted(a, key=away.get)[:3]) and home[k] in b


def test_default_overlap_holds_a_pair_across_a_border(spark, monkeypatch):
    """Fixed centres, both ends 0.12 from the border, no row for the audit: the overlap alone must hold the pair."""
    monkeypatch.setattr(embedding_graph, "fit_centres", lambda *_: np.array([[1.0, 0.0], [0.0, 1.0]]))
    data = [(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in ((1, np.pi / 4 - 0.12), (2, np.pi / 4 + 0.12))]
    got = embedding_graph.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_search_finds_a_chain():
    """Rows of which each is in range of the next only: the range grows along edges in range of the query alone."""
    angles = np.linspace(0, 1.2, 40)
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    q, r = embedding_graph.search(x, embedding_graph.prune(x), x, 0.95)
    assert {(a, b) for a, b in zip(q.tolist(), r.tolist())} == {(a, b) for a in range(40) for b in range(40) if x[a] @ x[b] >= 0.95 - 1e-9}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
