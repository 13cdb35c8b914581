"""Operators on texts against plain Python, over edge cases: nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanery.llm import byte_bpe, chosen_path, language_id, mixing, quality_rules, queries, substring_dedup, token_counts
from gleanery.llm.common import join_hot

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, tokens int, n_tokens string, size int"
PASSAGE = " ".join(f"word{i}" for i in range(70))


def rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [say(120) for _ in range(6)]
    near = []
    for t in base[:3]:
        for k in range(5):
            w = t.split()
            w[k * 7 % len(w)] = f"new{k}"
            near.append(" ".join(w))
    texts = base + near + base[:2] + [None, "", " \n ", "a b", "a b", "a b c d", "###", "<|endoftext|> naïve 東京\tx\r\ny", "ab " * 30_000, PASSAGE + " " + say(20), say(15) + "  " + PASSAGE, say(9) + "\n" + PASSAGE, PASSAGE]
    out = [(i + 1, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, 0.5, "x", 1, "y", 2) for i, t in enumerate(texts)]
    out += [(None, base[0], "en", "src0", 1, None, None, None, None, None), (2, base[1], "en", "src1", 1, None, None, None, None, None), (5, "another text under one id", "de", "zzz", 1, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def links_by_hand(data, threshold=0.8):
    sets = [grams(t) if i is not None else None for i, t in data]
    n, group = [0] * len(data), list(range(len(data)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, least.get(find(k)) if i is not None else None, n[k]) for k, (i, _) in enumerate(data))


@pytest.mark.parametrize("limit,cell", [(512, 512), (3, 4)])
def test_chosen_path_equals_brute_force(docs, limit, cell):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.jaccard_join(docs, limit=limit, cell=cell).collect())
    assert got == links_by_hand([r[:2] for r in rows()])


def test_chosen_path_large_group(spark):
    """A group too large for one cell: every link is counted, and a copy's links too."""
    words = [f"t{i}" for i in range(200)]
    data = [(k, " ".join(words[:k % 20] + [f"own{k % 50}"] + words[k % 20 :])) for k in range(90)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), limit=5, cell=12).collect())
    assert got == links_by_hand(data)


def test_chosen_path_no_rows(none):
    assert chosen_path.jaccard_join(none).count() == 0


def test_join_hot_equals_a_join(spark):
    """Heavy, light and null keys, and keys without facts."""
    rows = spark.createDataFrame([(i, b"hot" if i % 3 else (None if i % 2 else b"k%d" % i)) for i in range(300)], "i long, node binary")
    facts = rows.where("node is not null and i % 9 <> 6").groupBy("node").agg(F.count("*").alias("copies"), F.min("i").alias("rep"))
    for shares in (2, 20, 1000):
        got = sorted(tuple(x) for x in join_hot(rows, facts, "node", "copies", shares).select("i", "node", "copies", "rep").collect())
        assert got == sorted(tuple(x) for x in rows.join(facts, "node", "left").select("i", "node", "copies", "rep").collect())


def test_runs_follow_the_recall():
    assert chosen_path.runs_for(0.99999, 0.8) == 9 and chosen_path.runs_for(0.5, 0.8) == 1


def test_runs_repeat_until_the_measured_recall(spark):
    """Planted pairs that share 52 of 64 tokens in crowded buckets: one run parts many of them, the runs that measuring adds bring them together."""
    r = random.Random(1)
    data = []
    for k in range(500):
        a = [r.randrange(4) for _ in range(64)]
        b = list(a)
        for p in r.sample(range(64), 12):
            b[p] = 4 + r.randrange(1000)
        data += [(b"%04d" % (2 * k), a, 1), (b"%04d" % (2 * k + 1), b, 0)]
    df = spark.createDataFrame(data, "node binary, sig array<int>, asked long")

    def met(rows):
        of = {}
        for node, bucket in rows:
            of.setdefault(bucket, set()).add(int(node))
        return len({n // 2 for nodes in of.values() for n in nodes if n ^ 1 in nodes})

    once = [(x.node, x.bucket) for x in chosen_path.split_runs(df, range(1), 2).collect()]
    alone = df.join(spark.createDataFrame(once, "node binary, bucket long").groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node", "left")
    assert chosen_path.measured_recall(alone, 0.8) == chosen_path.measured_recall(alone, 0.8, block=90) == pytest.approx(met(once) / 500)
    assert chosen_path.runs_for(0.9, 0.8) == 2
    found = chosen_path.buckets_of(df, 0.9, 0.8, 2).where("b is not null").selectExpr("node", "explode(buckets) as bucket").collect()
    assert met(once) < 0.9 * 500 <= met([(x.node, x.bucket) for x in found])


def repeats_by_hand(data):
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in data if i is not None and t):
        w = t.encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    result = []
    for i, t in data:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        result.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return Counter(result)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring_dedup_equals_brute_force(docs, hot):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, hot=hot).collect())
    want = repeats_by_hand([r[:2] for r in rows()])
    assert got == want
    assert any(r[2] for r in want)


def test_substring_dedup_carries_columns(docs, none):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, carry=("text", "lang")).collect()}
    given = {r[0]: r for r in rows()}
    assert all(got[i].text == given[i][1] for i in got if i and got[i].n_removed == 0 and i not in (2, 5))
    assert all(len(r.text.split()) == r.n_words - r.n_removed for r in got.values() if r.n_removed)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_token_counts_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows())
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, path, memo_entries=7).collect())
    assert got == want and token_counts.count_tokens(none, path).count() == 0


def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_by_hand(data):
    """op8's rows of ``data`` (doc_id, text) by the library."""
    enc, out = library(), []
    for i, t in data:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_token_queries_equal_the_libraries(spark, sf_dir):
    """op2 and op8 over the whole table."""
    from tokenizers import Tokenizer

    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in data)
    assert Counter(map(tuple, queries.QUERIES["op2_token_counts"](spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want
    got = queries.QUERIES["op8_byte_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == Counter(encoded_by_hand(data))


def test_byte_bpe_equals_the_library(docs, none):
    path, enc = public_tokenizers.path("byte_bpe_50k.tiktoken"), library()
    got = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    assert Counter(tuple(r) for r in got.collect()) == Counter(encoded_by_hand(r[:2] for r in rows()))
    kept = byte_bpe.encode_decode(docs.where("doc_id = 1"), path, public_tokenizers.PATTERN, keep=True, carry=("lang",)).first()
    assert kept.token_ids == enc.encode_ordinary(rows()[0][1])
    assert byte_bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_random_bytes_like_pieces():
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    own, r = byte_bpe.Encoder(path, memo=50), random.Random(1)
    for _ in range(300):
        piece = "".join(r.choice("abcdetionsr éü東'’ 0123") for _ in range(r.randint(1, 60)))
        assert own.walk(piece.encode()) == enc.encode_ordinary(piece)


def test_language_id(spark, sf_dir, docs, none):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    right = sum(r.lang == r.lang_pred for r in held) / len(held)
    assert right > 0.9
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    edge = {r.doc_id: r for r in language_id.identify(docs, carry=("text", "source")).collect()}
    assert edge[24].lang_pred == "und" and edge[25].lang_pred == "und" and edge[1].text == rows()[0][1]
    assert len(language_id.identify(docs).collect()) == len(rows())
    assert language_id.identify(none).count() == 0


def predicted_by_hand(model, text):
    """The prediction again in plain Python: letters by category, grams in a dict, machines and votes one by one."""
    import math
    import unicodedata

    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    bare = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    # runs of gaps are one space; two spaces go before, one after
    s = [" ", " "] + [c for k, c in enumerate(bare) if c != " " or k == 0 or bare[k - 1] != " "] + [" "]
    codes, counts = [ord(c) for c in s], {}
    mul = lambda a, b: a * b & 0xFFFFFFFF
    two = lambda i: mul(mul(codes[i - 1], 0x9E3779B1) ^ mul(codes[i], 0x85EBCA6B), 0xC2B2AE35)
    for i in range(2, len(codes)):
        for g in (mul(codes[i], 0x9E3779B1), two(i), mul(two(i - 1) ^ mul(codes[i], 0x27D4EB2F), 0x165667B1)):
            counts[g >> 19] = counts.get(g >> 19, 0) + 1
    weights = {k: math.log1p(v) for k, v in counts.items()}
    size = math.sqrt(sum(v * v for v in weights.values()))
    margin = lambda r: sum(v / size * float(model.weights[r, k]) for k, v in weights.items()) + float(model.weights[r, -1])
    sure = lambda r: 1 / (1 + math.exp(-4 * margin(r)))
    shares = {f: sure(r) for f, r in model.family_rows.items()}
    family = max(sorted(shares), key=shares.get)
    votes, belief = {}, {}
    for (a, b), r in model.pair_rows.items():
        if a in model.members[family]:
            p = sure(r)
            votes[a if p >= 0.5 else b] = votes.get(a if p >= 0.5 else b, 0) + 1
            belief[a], belief[b] = belief.get(a, 0) + p, belief.get(b, 0) + 1 - p
    langs = sorted(model.members[family])
    best = max(langs, key=lambda k: (votes.get(k, 0), belief.get(k, 0)))
    return best, shares[family] / sum(shares.values()) * (belief[best] / (len(langs) - 1) if len(langs) > 1 else 1)


def test_language_id_equals_plain_python(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(table.where(language_id.remainder() != 0))
    texts = [r.text for r in table.where("length(text) < 4000").collect()] + ["½", "Ⅷ ²①", "été", "1 a", "  Größe\t\n12", "東京 ½"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        lang, score = predicted_by_hand(model, texts[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-4))
    assert {r.lang_pred for r in got if r.doc_id in (len(texts) - 6, len(texts) - 5)} == {"und"}


def test_language_id_ties_and_many_labels(spark):
    """Equal margins: the first by name. Of more labels than ``languages``, the commonest are learned."""
    model = language_id.Model({"x": ["b", "a"], "w": ["c"]}, np.zeros((3, language_id.DIM + 1), np.float32), {"x": 0, "w": 1}, {("b", "a"): 2})
    assert model.decide(np.zeros(3))[:2] == ("c", "w")
    model.family_rows = {"x": 0, "w": 1}
    assert model.decide(np.array([1.0, 0.0, 0.0]))[0] == "b"  # half a vote goes to the first of a pair
    data = [(k, f"text of label {k % 30} " * 3, f"l{k % 30:02d}") for k in range(300)] + [(900 + k, "more words", "l29") for k in range(5)]
    found = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), languages=7, most_rows=70)
    assert sorted(sum(found.members.values(), [])) == ["l00", "l01", "l02", "l03", "l04", "l05", "l29"]


def test_language_id_reads_no_label(spark, sf_dir):
    """A label that changes on a held-out row changes nothing."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = table.selectExpr("doc_id", "text", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 'xx', lang) as lang")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(t).collect()} for t in (table, other))
    assert a == b


def base_by_hand(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


def test_quality_rules_base_equals_brute_force(spark, sf_dir, docs, none):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    for df in (docs, table):
        want = Counter((r.doc_id, *base_by_hand(r.text)) for r in df.collect())
        got = quality_rules.judge(df)
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == want
        assert got.where("base_failed and kept").count() == 0
    assert quality_rules.judge(none).count() == 0


def verdicts_by_hand(data, min_words=60, min_chars=200, most_char=0.3, most_word=0.45, per_language=16, languages=32):
    """(kept, nearest) of rows (doc_id, text, lang): words counted, histograms, references and distances in plain Python."""
    import math
    import re
    import unicodedata

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    letters = lambda w: all(unicodedata.category(c)[0] == "L" for c in w)
    counts = {}
    for _, t, k in data:
        if k is not None and t is not None:
            counts.setdefault(k, Counter()).update(w for w in split(t.lower()) if letters(w) and len(w) <= 40)
    docs_of = Counter(k for _, t, k in data if k is not None)
    listed = sorted(docs_of, key=lambda k: (-docs_of[k], k))[:languages]
    common = sorted({w for c in (counts.get(k, {}) for k in listed) for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:per_language]})

    def bins(t):
        of = Counter()
        for c in t or "":
            kind = "l" if "a" <= c <= "z" else " " if c in " \t\n\x0b\x0c\r" else "u" if "A" <= c <= "Z" else "s" if c in "#*$%&|<>" else "L" if unicodedata.category(c)[0] == "L" else "d" if c in "0123456789" else "m" if c in ".,;:!?'\"()-" else "o"
            of[kind] += 1
        words = [w.lower() for w in split(t)]
        seen = Counter(w for w in words if w in common)
        return [of[k] for k in "l usLdmo"], [seen[w] for w in common] + [len(words) - sum(seen.values())]

    both = [bins(t) for _, t, _ in data]
    refs = {}
    for (_, _, k), (c, w) in zip(data, both):
        if k in counts:
            a, b = refs.get(k, ([0] * len(c), [0] * len(w)))
            refs[k] = [x + y for x, y in zip(a, c)], [x + y for x, y in zip(b, w)]
    refs = {k: v for k, v in refs.items() if sum(v[1]) >= 500}

    def far(p, q):
        if not sum(p):
            return 1.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))

    out = []
    for (i, t, k), (c, w) in zip(data, both):
        base = base_by_hand(t)
        near = min(((far(c, a) + far(w, b), name, far(c, a), far(w, b)) for name, (a, b) in refs.items() if name in listed or name == k), default=None) if k is None or k in refs else None
        bad = near is not None and ((base[1] >= min_chars and near[2] > most_char) or (base[0] >= min_words and near[3] > most_word))
        out.append((i, not base[5] and not bad, near and near[1]))
    return Counter(out)


def test_quality_rules_verdict_equals_brute_force(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-1, "dit is een tekst in een taal " * 3 + "zonder referentie hier", "nl")], "doc_id long, text string, lang string")
    for df in (docs.select("doc_id", "text", "lang"), table.unionByName(rare)):
        want = verdicts_by_hand([tuple(r) for r in df.collect()])
        assert Counter((r.doc_id, r.kept, r.nearest) for r in quality_rules.judge(df).collect()) == want
    assert len({k for _, k, _ in want}) == 2 and len({n for *_, n in want}) >= 4


@pytest.mark.parametrize("languages", [1, 2])
def test_quality_rules_of_rarer_languages_equal_brute_force(spark, sf_dir, languages):
    """Languages beyond the commonest are judged by references of their own; one of too few words has none."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "dit is een tekst in een taal " * 3 + "zonder referentie hier", "nl"), (-2, None, "pt"), (-3, "", "de"), (-4, "1 2 3 4 " * 90, "de"), (None, "x y", None)]
    df = table.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    want = verdicts_by_hand([tuple(r) for r in df.collect()], languages=languages)
    assert Counter((r.doc_id, r.kept, r.nearest) for r in quality_rules.judge(df, languages=languages).collect()) == want
    assert len({n for *_, n in want}) >= 4


def test_quality_rules_distance_by_hand(spark):
    p, q = np.array([3, 0, 7, 1]) / 11, np.array([0.2, 0.3, 0.5, 0.0])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    df = spark.createDataFrame([([3, 0, 7, 1],)], "c array<long>")
    assert df.select(quality_rules.js_distance("c", list(q))).first()[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_rake_meets_marginals():
    cells = {(s, k, t): 100 + 7 * i for i, (s, k, t) in enumerate((s, k, t) for s in "ab" for k in ("en", "de") for t in ("t0", "t1"))}
    targets = {"source": {"a": 0.6, "b": 0.4, "gone": 3.0}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"t0": 0.45, "t1": 0.55}}
    found = mixing.rake(cells, targets, 0.5)
    total = 0.5 * sum(cells.values())
    for axis, name in enumerate(mixing.AXES):
        share = {v: w for v, w in targets[name].items() if v != "gone"}
        for value, weight in share.items():
            assert sum(w for k, w in found.weight.items() if k[axis] == value) == pytest.approx(total * weight / sum(share.values()), rel=1e-6)
    assert all(0 <= p <= 1 for p in found.probability.values())


def test_rake_respects_caps_and_emptiness():
    cells = {("a", "en", "t0"): 10, ("b", "en", "t0"): 1000}
    found = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 1.0}, "topic": {"t0": 1.0}}, 0.5)
    assert found.probability["a", "en", "t0"] == pytest.approx(1.0) and found.error > 0
    assert mixing.rake({}, {**mixing.DEFAULT_TARGETS, "topic": {}}, 0.5).probability == {}


def mixed_by_hand(data, model, targets, fraction):
    """(lang, topic, tokens) of each row and the probability of each cell, without numpy's help for the raking: cells scaled to one marginal after another."""
    read = []
    for i, text, lang, source in data:
        words = (text or "").lower().encode().split()
        places = Counter(int(h) >> 56 for h in mixing.word_hashes([w for w in words if len(w) > 3])) if any(len(w) > 3 for w in words) else {}
        group = lang if lang in targets["lang"] else "other"
        scores = [sum(np.log1p(n) * model.weight[group][p] * c[p] for p, n in places.items()) for c in model.centres.get(group, [])]
        best = next((k for k, x in enumerate(scores) if x >= max(scores) - 1e-12), 0)
        read.append((source if source in targets["source"] else "other", group, f"{group}:{best}", max(1, len(words))))
    cells = Counter()
    for s, k, t, n in read:
        cells[s, k, t] += n
    langs = {k for _, k, _ in cells}
    goal = [targets["source"], targets["lang"], {t: targets["lang"][k] / len({t for _, j, t in cells if j == k}) for k in langs for _, j, t in cells if j == k}]
    budget = fraction * sum(cells.values())
    mass = {c: n * fraction for c, n in cells.items()}
    wants = []
    for axis in range(3):  # a value gives no more than it has, the others take the rest
        has, want, values = Counter(), {}, {c[axis] for c in cells}
        for c, n in cells.items():
            has[c[axis]] += n
        while values:
            rest, share = budget - sum(want.values()), sum(goal[axis][v] for v in values)
            short = {v for v in values if rest * goal[axis][v] / share >= has[v]}
            want |= {v: has[v] if v in short else rest * goal[axis][v] / share for v in (short or values)}
            values -= short or values
        wants.append(want)
    for _ in range(500):
        for axis in range(3):
            for v, want in wants[axis].items():
                own = [c for c in cells if c[axis] == v]
                for _ in own:  # cells at their cap stay, the others make up for them
                    full = [c for c in own if mass[c] >= cells[c] * (1 - 1e-12)]
                    open_ = sum(mass[c] for c in own if c not in full)
                    left = want - sum(cells[c] for c in full)
                    if left < 0:
                        total = sum(mass[c] for c in own)
                        mass |= {c: mass[c] * want / total for c in own}
                        break
                    mass |= {c: min(cells[c], mass[c] * left / open_) for c in own if c not in full and open_}
                    if len([c for c in own if mass[c] >= cells[c] * (1 - 1e-12)]) == len(full):
                        break
    return read, {c: mass[c] / n for c, n in cells.items()}


def test_mixing_equals_plain_python(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    targets = {"source": {"src0": 1.0, "src1": 1.0, "src2": 2.0, "other": 6.0}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, "other": 0.05}}
    own = table.select("doc_id", mixing.under(F.col("lang"), targets["lang"]).alias("lang_group"), "text")
    model = mixing.fit_topics(mixing.sample_counts(own, 60), 3, 10)
    data = [tuple(r) for r in table.collect()]
    read, rates = mixed_by_hand(data, model, targets, 0.05)
    got = {r.doc_id: r for r in mixing.mix(table, targets, fraction=0.05, topics=3, sample=60, per_topic=10).collect()}
    assert {i: (r.source_group, r.lang_group, r.topic, r.tokens) for i, r in got.items()} == {d[0]: x for d, x in zip(data, read)}
    assert {x[:3]: got[d[0]].probability for d, x in zip(data, read)} == pytest.approx({x[:3]: rates[x[:3]] for x in read}, abs=1e-3)
    assert len({r.error for r in got.values()}) == 1 and len({r.topic for r in got.values()}) > 8


def test_mixing(spark, sf_dir, docs, none):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {r.doc_id: r for r in mixing.mix(table).collect()}
    b = {r.doc_id: r for r in mixing.mix(table.repartition(7)).collect()}
    assert {i: r.kept for i, r in a.items()} == {i: r.kept for i, r in b.items()}
    expected, taken = sum(r.tokens * r.probability for r in a.values()), sum(r.tokens for r in a.values() if r.kept)
    assert 0.9 < expected / (0.5 * sum(r.tokens for r in a.values())) < 1.001 and abs(taken - expected) < 0.35 * expected
    edge = mixing.mix(docs, carry=("text",)).collect()
    assert len(edge) == len(rows()) and all(r.probability is not None for r in edge)
    assert {r.source_group for r in edge} >= {"other", "src0"} and mixing.mix(none).count() == 0
    columns = {"topic": F.when(F.col("doc_id") < 5, "low").otherwise("high"), "tokens": F.lit(3)}
    chosen = mixing.mix(docs, mixing.DEFAULT_TARGETS | {"topic": {"low": 0.2, "other": 0.8}}, **columns).collect()
    assert {r.topic for r in chosen} == {"low", "other"} and {r.tokens for r in chosen} == {3}
