"""Training-data operators against brute force, round trips and held-out accuracy, with odd inputs for each."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from relatrix.llm import dartminhash, gif, katz, media, mixing, neardup, packing, quality_model, quality_rules, queries, sharding, token_counts, toxicity, wordtokens

SF = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 3), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (None, "no id here at all", "en", None, 1),
    (5, LONG, "en", "t", 1), (6, LONG, "de", "t", 1), (7, "ünï <|endoftext|> 'S it's 12 ΑΣ İx y.", "xx", "u", 1), (8, "A line. Next line.\nA line. Next line.\nEnd of it all here now.", "en", "u", 1),
]
OPERATORS = {
    "op1": lambda d, lab: packing.pack(d),
    "op2": lambda d, lab: neardup.near_duplicates(d),
    "op3": lambda d, lab: mixing.mix(d),
    "op4": lambda d, lab: quality_rules.clean_lines(d),
    "op5": lambda d, lab: quality_model.quality(d, lab),
    "op6": lambda d, lab: toxicity.toxicity(d, lab),
    "op7": lambda d, lab: sharding.assign_shards(d),
    "op8": lambda d, lab: media.payload_digest(d),
    "op9": lambda d, lab: token_counts.token_counts(d),
    "op10": lambda d, lab: katz.katz_scores(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, COLS)
    for c in ("row", "k", "t", "kept", "size", "score", "node", "label", "position", "part"):  # clashing names
        d = d.withColumn(c, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, 0, 1), (5, 1, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("op", OPERATORS)
def test_odd_rows_and_empty_table(spark, odd, labels, op):
    rows = OPERATORS[op](odd, labels).collect()
    if op == "op1":
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    else:
        assert len(rows) == len(ODD)
    assert OPERATORS[op](odd.limit(0), labels).count() == 0
    assert OPERATORS[op](odd, labels.limit(0)).count() == len(rows)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordtokens.tokenizer_path())


PIECES = st.one_of(st.text(max_size=8), st.sampled_from(["The", "it's", "<|endoftext|>", "Straße.", "naïve,", "x" * 70, "é", "...", "İ", "ΑΣ", "12a"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30), st.sampled_from([" ", "\n", " \t", "\r\n"]))
def test_word_ids_are_the_librarys(tokenizer, parts, blank):
    t = blank.join(parts)
    ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert wordtokens.worker_tokens(wordtokens.tokenizer_path()).ids(t) == ids


def test_token_counts(docs, odd, tokenizer):
    for d in (docs, odd):
        text = [r.text or "" for r in d.collect()]
        got = token_counts.token_counts(d).collect()
        assert [r.n_tokens for r in got] == [len(e.ids) for e in tokenizer.encode_batch(text, add_special_tokens=False)]
        assert [r.n_bytes for r in got] == [len(t.encode()) for t in text]
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=300), st.integers(1, 40))
def test_pieces_end_at_blanks(text, limit):
    parts = list(token_counts.pieces(text, limit))
    assert "".join(parts) == text and all(p[0] in " \n\t" for p in parts[1:])
    assert all(len(p) <= limit or not re.search(r"[ \n\t]", p[1:]) for p in parts)


def test_token_counts_with_another_tokenizer_and_one_very_long_text(spark, tokenizer):
    from tokenizers import Tokenizer

    other = wordtokens.tokenizer_path("byte_bpe_50k.json")
    text = LONG + " <|endoftext|>  x\n\n" + "y" * 100_000 + " end"
    d = spark.createDataFrame([(1, text), (2, "a  b")], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.token_counts(d).collect()] == [len(tokenizer.encode(t, add_special_tokens=False)) for t in (text, "a  b")]
    lib = Tokenizer.from_file(other)
    assert [r.n_tokens for r in token_counts.token_counts(d, tokenizer=other).collect()] == [len(lib.encode(t, add_special_tokens=False)) for t in (text, "a  b")]
    assert wordtokens.parts_at_blanks(wordtokens.tokenizer_path()) and not wordtokens.parts_at_blanks(other)
    with pytest.raises(ValueError):
        wordtokens.WordTokens(other)


def test_packing(docs, texts, tokenizer):
    rows = packing.pack(docs, pool_tokens=50_000).collect()
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        spans[r.doc_id].append((r.start, r.length, len(ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in (*[[(a, n) for a, n, _ in v] for v in spans.values()], *sequences.values()):
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
    assert all(sum(n for _, n, _ in v) == v[0][2] for v in spans.values())
    full = [sum(n for _, n in v) for v in sequences.values()]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in full)
    assert max(full) <= 2048 and padded == 0 and set(spans) == set(texts)


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randrange(20, 700) for _ in range(4000)]
    held, n = packing.place(lengths, 2048, 1.0, 1 / 2048)
    cost = [sum(k + k * k / 2048 for _, _, k in s) for s in held[:n]]
    assert all(sum(k for _, _, k in s) == 2048 for s in held[:n])
    assert sum(k for s in held for _, _, k in s) == sum(lengths)
    first_fit, room = [], 0
    for k in lengths:  # in order, cut at the end: what no balancing gives
        if not room:
            first_fit.append(0.0)
            room = 2048
        take = min(k, room)
        first_fit[-1] += take + take * take / 2048
        room -= take
    assert np.std(cost) < np.std(first_fit)


def brute_classes(rows, size=5, threshold=0.8, weights="count"):
    bags = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bag = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])
        bags.append(bag if weights == "count" else Counter(set(bag)))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (bags[i] and bags[j] and (bags[i] & bags[j]).total() / (bags[i] | bags[j]).total() >= threshold):
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return {k: min(v) for v in least.values() for k in v}


def drifting(n, words, rng, edits):
    out, w = [], [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        w = list(w)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "dense", "weights"), [(8, 20, "count"), (2, 20, "set"), (2, 0, "count")])
def test_near_duplicates_equal_brute_force(spark, small, dense, weights, monkeypatch):
    """Chains of near copies that drift apart, exact copies, a shared passage, repeated lines; with `small` 2 nearly
    every key is large, with `dense` 0 hubs are tried as long as they find links."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "DENSE", dense)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    line = " ".join(rng.choice(words) for _ in range(9)) + "\n"
    t = drifting(25, words, rng, 2) + drifting(12, words, rng, 4)
    t += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(14)]
    t += [x + "\n" + line * k for x in (t[0], passage) for k in (1, 2, 3, 9, 10, 40, 45)]
    t += [t[3]] * 10 + ["", "", None, "a b", "a b", "c"]
    rng.shuffle(t)
    rows = list(enumerate(t))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weights=weights).collect()
    want = brute_classes(rows, weights=weights)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.representative for r in got) == len(set(want.values()))
    assert all(r.class_size == list(want.values()).count(r.class_id) for r in got)
    kept = neardup.representatives(spark.createDataFrame(rows + rows[:5], "doc_id long, text string"), weights=weights)
    assert kept.count() == len(set(want.values()))


def test_near_duplicates_of_one_hot_family(spark):
    """Many copies of one text with one to thirty edits each: far outliers stay alone, no link is lost."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(1, 30) if i % 3 else 1):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**62, 300).astype(np.uint64)
    a, b = rng.random(300) * 8, rng.random(300) * 8
    s = dartminhash.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    for n in (1, 7, 20_000):  # every coordinate is filled, whatever the size
        assert (dartminhash.signatures(rng.integers(0, 2**62, n).astype(np.uint64), None, np.zeros(n, np.int64), 1, 64) != 0).all()


def test_packing_takes_the_cheapest_of_all_sequences_with_room():
    rng = random.Random(3)
    for size in (64, 256):
        lengths = [rng.randint(size // 3, size - 1) if rng.random() < 0.3 else rng.randint(1, size // 3) for _ in range(1500)]
        n = sum(lengths) // size
        room, spent, held, whole = [size] * n, [0.0] * n, [[] for _ in range(n)], set()
        for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = lengths[d]
            to = min((s for s in range(n) if room[s] >= k), key=lambda s: (spent[s], s), default=-1)
            if to >= 0:
                held[to].append((d, 0, k))
                room[to] -= k
                spent[to] += 1.0 * k + k * k / 2048
                whole.add(d)
        got, full = packing.place(lengths, size, 1.0, 1 / 2048)
        assert full == n and [[p for p in g if p[0] in whole] for g in got[:n]] == held
        assert sum(p[2] for g in got for p in g) == sum(lengths) and all(sum(p[2] for p in g) == size for g in got[:n])


def test_mixing(docs, texts):
    rows = mixing.mix(docs).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in texts.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    by = Counter()
    for k, n in size.items():
        by[source[k]] += n
    names = sorted(by)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(by.values()))
    while True:  # share, stop at the cap, share the rest again
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * by[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and abs(r.target - target[r.source]) < 1e-6 * r.target + 1e-6
        assert r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.passes)
        assert all(0 <= p.position <= 1 for p in r.passes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_curriculum_order_and_schedule(spark):
    d = spark.createDataFrame([(i, "a b c d", "en", s, 7) for i, s in enumerate(["p"] * 50 + ["q"] * 50 + ["r"] * 50)], COLS)
    got = mixing.curriculum(mixing.mix(d, carry=True)).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    early = Counter(r.source for r in got if r.position < 0.5)
    whole = Counter(r.source for r in got)
    assert early["p"] / whole["p"] < 0.5 < early["r"] / whole["r"]


def test_op3_query_returns_documents_in_training_order(spark, docs, texts):
    d = queries.QUERIES["op3_mixing"](spark, SF)
    assert d.columns[:7] == ["doc_id", "size", "source_size", "target", "taken", "passes", "first_position"]
    got = d.collect()
    at = [2.0 if r.first_position is None else r.first_position for r in got]
    assert at == sorted(at) and at[0] == 0 and at[-1] == 2.0
    want = {r.doc_id: (r.passes, r.first_position) for r in mixing.mix(docs).collect()}
    assert {r.doc_id: (r.passes, r.first_position) for r in got} == want and len(got) == len(texts)
    assert all((r.text or "") == texts[r.doc_id] and sum(p.words for p in r.passes) == r.taken for r in got)
    flat = {r.doc_id: r.first_position for r in mixing.mix(docs, slopes=(0.0,)).collect()}
    assert any(r.first_position != flat[r.doc_id] for r in got)


def test_quality_rules_equal_brute_force(docs, texts):
    d = quality_rules.clean_lines(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in d.collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_line_rules(spark):
    clean = "This is a plain first line of text.\nAnd here a second one follows it."
    rows = [(1, clean), (2, clean + "\nHome | News | Sport | Shop\nAll rights reserved by us all.\nMenu"), (3, "A | B | C | D | E | F | G | H | I | J | K | L\nOne real line stands here.\nAnother good one follows.")]
    got = {r.row.doc_id: (r.kept, r.clean_text) for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (True, clean) and got[2] == (True, clean) and got[3][0] is True
    nav = spark.createDataFrame([(1, "\n".join(f"Go{i} | To{i} | Up{i} | In{i}" for i in range(9)) + "\nOne real line.")], "doc_id long, text string")
    assert not quality_rules.clean_lines(nav).first().kept


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_model", "quality", 0.93), ("op6_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    d = queries.QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", label, "score").collect()
    assert np.mean([r[0] == r[1] for r in d]) >= least
    for y in (0, 1):  # recall of either class, which a constant answer has not
        assert np.mean([r[0] == y for r in d if r[1] == y]) >= 0.85, y
    good, bad = (np.array([r.score for r in d if r[1] == y]) for y in (1, 0))
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    assert auc >= 0.95


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y, pairs=1)
    assert {m.pairs[0][0], m.pairs[0][1]} == {0, 1}
    assert ((m.probability(x) > 0.5) == y).mean() > 0.95


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-5, 5).filter(lambda v: abs(v) > 0.01), max_size=30))
def test_segments_are_maximal(values):
    """Equal to the definition: take the best segment, then the same to its left and right."""
    values = [v + 1e-3 * random.Random(i).random() for i, v in enumerate(values)]  # no two sums are equal

    def best(lo, hi):
        cands = [(sum(values[a : b + 1]), a, b) for a in range(lo, hi) for b in range(a, hi)]
        if not cands or max(cands)[0] <= 0:
            return []
        _, a, b = max(cands)
        return best(lo, a) + [(a, b)] + best(b + 1, hi)

    got = toxicity.segments(list(enumerate(values)), -1.0)
    assert [(a, b) for a, b, _ in got] == best(0, len(values))
    assert all(abs(s - sum(values[a : b + 1])) < 1e-9 for a, b, s in got)


def test_segments_take_linear_time():
    import sys

    def steps(values):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "line"
            return count

        sys.settrace(count)
        toxicity.segments(list(enumerate(values)), -1.0)
        sys.settrace(None)
        return n

    for shape in (lambda n: [1.0, -1.5] * n, lambda n: [1.0, -0.5] * n, lambda n: [3.0 - 4.0 * (i % 2) + i % 7 / 10 for i in range(2 * n)], lambda n: [*([2.0, -1.9] * n), *([1.0, -1.2] * n)]):
        assert steps(shape(2000)) < 4.6 * steps(shape(500))


def test_toxicity_score_equals_a_full_scan_of_words_with_several_marks(spark):
    model = toxicity.ToxicityModel({"idiot": 6.0, "moron": 5.0, "thanks": -3.0}, -0.5, 1.0, 0.0, 1.0, -1.0)
    texts = [f"you {a}idiot{b} and {a}moron{b} there" for a in ("", ",", "..", "¡¡") for b in ("", "!", "!!", "...", "?!", "\u2026\u2026", "?!.,", '!"')]
    texts += ["idiot!! thanks", "so kind, thanks!!", "!!", "", None, " \n"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        kept, x = model.scan(toxicity.tokens_of(t or ""))
        assert [tuple(p) for p in got[i].passages] == [(a, b + 1, s) for a, b, s in kept], t
        assert got[i].score == model.probability(x)
    assert all(got[i].passages for i in range(32))


@pytest.mark.parametrize("same", [False, True])
def test_sharding(spark, docs, texts, same):
    if same:  # a third of all rows with one text, and repeated rows
        docs = docs.select("doc_id", "text").union(docs.select(F.lit(7).cast("long"), F.lit("hot text " * 30)).limit(100))
    rows = sharding.assign_shards(docs, range_bytes=1000).collect()
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
        if not same:
            t = texts[r.doc_id].encode()
            assert (r["size"], r.text_crc32) == (len(t) + 16, zlib.crc32(t))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == docs.count()
    mean, top = sum(load.values()) / 40, max(r["size"] for r in rows)
    assert all(abs(load[s] - mean) <= top for s in range(40))


def test_sharding_equals_brute_force(docs):
    """All rows on one line, by range, text hash and row hash: the middle byte of a row decides its shard."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    row_hash = lambda k, uid: signed(xxhash.xxh64_intdigest(uid.to_bytes(8, "little"), xxhash.xxh64_intdigest(str(k).encode(), 42)))
    at = {r.doc_id: (r.text or "", r.uid) for r in docs.withColumn("uid", F.monotonically_increasing_id()).collect()}
    got = {r.doc_id: r for r in sharding.assign_shards(docs, 40).collect()}
    line = sorted((got[k].key_range, signed(xxhash.xxh64_intdigest(t.encode(), 42)), row_hash(k, uid), uid, k) for k, (t, uid) in at.items())
    total, before, slots = sum(r["size"] for r in got.values()), 0, Counter()
    for *_, k in line:
        r = got[k]
        shard = min(39, (2 * before + r["size"]) * 40 // (2 * total))
        assert (r.shard, r.slot) == (shard, slots[shard])
        before += r["size"]
        slots[shard] += 1


def test_write_shards(docs, tmp_path):
    back = sharding.write_shards(docs, str(tmp_path / "s"), 5)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 5


def test_media_round_trip(odd, docs):
    for d in (docs, odd):
        want = [(r.text or "").encode() for r in d.collect()]
        for t, r in zip(want, media.payload_digest(d).collect()):
            p = t.ljust(max(1, -(-len(t) // 64)) * 64, b"\0")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.integers(2, 8))
def test_lzw_round_trip(data, bits):
    data = bytes(b & ((1 << bits) - 1) for b in data)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits) == data


def test_lzw_goes_over_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"a" * 50_000
    assert gif.lzw_decode(gif.lzw_encode(data, 8), 8) == data


def test_gif_rules():
    red, own = np.array([[255, 0, 0], [0, 255, 0]]), np.array([[0, 0, 255], [9, 9, 9]])
    frames = [
        gif.Frame(np.zeros((4, 4), np.uint8), delay_cs=5, disposal=1),
        gif.Frame(np.array([[1, 0], [0, 1]], np.uint8), 1, 1, 7, 3, transparent=0),
        gif.Frame(np.zeros((9, 2), np.uint8)[:3], 0, 0, 9, 2, palette=own),
        gif.Frame(np.arange(16, dtype=np.uint8).reshape(4, 4) % 2, delay_cs=1, interlaced=True),
    ]
    data = gif.encode(frames, 4, 4, red, 2)
    w, h, palette, back = gif.decode(data)
    assert (w, h) == (4, 4) and all((a.pixels == b.pixels).all() for a, b in zip(frames, back))
    seen = [c.copy() for c in gif.shown(w, h, palette, back)]
    assert tuple(seen[1][1, 1]) == (0, 255, 0, 255) and tuple(seen[1][1, 2]) == (255, 0, 0, 255)
    assert tuple(seen[2][1, 1]) == (0, 0, 255, 255) and tuple(seen[2][2, 2]) == (255, 0, 0, 255)
    listed, _ = media.read_one(data)
    assert listed[0]["red"][15] == 16 and listed[0]["green"][0] == 16 and listed[2]["blue"][15] == 6
    assert [f["at_ms"] for f in listed] == [0, 50, 120, 210] and [sum(listed[0][c]) for c in ("red", "green", "blue")] == [16] * 3
    for broken in (b"", b"GIF89a", data[:40], data[:60], b"x" * 99):
        with pytest.raises((ValueError, IndexError)):
            assert gif.decode(broken)[3], "no frame"
            raise ValueError


def test_katz_equals_brute_force(docs, texts):
    tok = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one, two = Counter(), Counter()
    for i, w in tok.items():
        if not held[i]:
            one.update(w)
            two.update(zip([b"", *w[:-1]], w))
    n, z = sum(one.values()), sum(one.values()) + len(one) + 1
    d = katz.discounts([sum(1 for x in two.values() if x == r) for r in range(1, 7)])
    after = defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = c
    back = {}
    for a, f in after.items():
        loss = sum((1 - d[c]) * c for c in f.values() if c <= 5)
        more, loss = (1, 1.0) if loss <= 0 else (0, loss)
        back[a] = (loss / (one[a] + more) / (1 - sum(one[b] + 1 for b in f) / z), more)

    def prob(a, b):
        if a not in after:
            return (one[b] + 1) / z
        if b in after[a]:
            c = after[a][b]
            return d[min(c, 6)] * c / (one[a] + back[a][1])
        return back[a][0] * (one[b] + 1) / z

    rows = katz.katz_scores(docs).collect()
    for r in rows:
        w = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(b in one for b in w), n)
        assert abs(r.score - sum(np.log10(prob(a, b)) for a, b in zip([b"", *w[:-1]], w))) < 1e-6 * abs(r.score)
        assert abs(r.base_score - sum(np.log10((one[b] + 1) / z) for b in w)) < 1e-6 * abs(r.base_score)
    for a in list(after)[:5]:  # sums to 1 with one share for all unknown words
        assert abs(sum(prob(a, b) for b in one) + prob(a, b"\0unknown") - 1) < 1e-9
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    text = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.itertuples(index=False))
    assert text(got) == text(want)


CLASHES = ("position", "_words", "_size", "clean_text_", "media_", "c1", "shard", "slot", "key_range", "row", "size", "k", "t", "p", "passes", "label", "kept")


def test_clashing_names(spark, tmp_path):
    d = spark.createDataFrame([(i, f"a line of {i} words stands here. One more of them.", "en", "s", 1) for i in range(12)], COLS)
    for c in CLASHES:
        d = d.withColumn(c, F.lit("x"))
    same = lambda e: all(r[c] == "x" for r in e.collect() for c in CLASHES if c in e.columns)
    kept = quality_rules.kept_documents(d)
    assert kept.columns == d.columns and same(kept) and kept.count() == 12
    taught = mixing.curriculum(mixing.mix(d, carry=True), position=None)
    assert taught.columns == d.columns and same(taught) and taught.count() == 12
    assert mixing.curriculum(mixing.mix(d, carry=True)).schema["position"].dataType.typeName() == "double"
    gifs = d.join(media.store_texts(d).select("doc_id", "media"), "doc_id")
    read = media.read_gifs(gifs)
    assert same(read) and all(len(r.frames) == 1 for r in read.collect())
    back = sharding.write_shards(d, str(tmp_path / "s"), 3)
    assert back.count() == 12 and back.select("shard").distinct().count() == 3 and set(d.columns) <= set(back.columns)
    assert same(neardup.representatives(d))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert same(toxicity.toxicity(d, labels, carry=True).select("row.*"))


@pytest.mark.parametrize("case", ["empty", "null texts", "odd"])
def test_pipeline_stages_on_odd_inputs(spark, odd, case):
    """Each stage on a table without rows, on null and empty texts only, and on odd rows with clashing names."""
    import corpus_pipeline as p

    wide = odd.select(*[F.col(c) for c in odd.columns])
    for c in CLASHES:
        wide = wide.withColumn(c, F.lit("x"))
    d = {"empty": odd.limit(0), "null texts": odd.filter("text IS NULL OR text = ''"), "odd": wide}[case]
    for name, stage in p.STAGES:
        out = stage(spark, d, SF)
        n = out.count()
        if name != "packing":
            assert out.columns == d.columns, name
            assert all(r[c] == "x" for r in out.collect() for c in CLASHES if c in out.columns)
        if case == "empty":
            assert n == 0
    if case != "odd":
        for name, stage in p.STAGES:  # in a row: the first stage drops everything
            d = stage(spark, d, SF)
        assert d.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    d = docs
    for name, stage in p.STAGES:
        d = stage(spark, d, SF).persist()
        at[name] = d
        if name != "packing":
            assert d.columns == docs.columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    rules = quality_rules.clean_lines(docs)
    assert ids(at["quality_rules"]) == {r[0] for r in rules.filter("kept").select("row.doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in at["toxicity"].collect()]
    assert {k for k, _ in rows} <= ids(at["quality_rules"])
    classes = brute_classes(rows)
    kept = ids(at["near_duplicates"])
    assert len(kept) == len(set(classes.values())) and {classes[k] for k in kept} == set(classes.values())
    words = lambda d: sum(len(r.text.split()) for r in d.collect())
    assert abs(words(at["mixing"]) - words(at["near_duplicates"])) <= 20
    assert ids(at["packing"]) == ids(at["mixing"])
    tokens = lambda d: Counter({r.doc_id: r.n for r in d.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()})
    assert tokens(p.run(spark, SF)) == tokens(at["packing"])  # how documents are cut depends on the partitions
