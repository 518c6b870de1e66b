"""Each operator against brute force on a small fixture with every awkward case, and on an empty table."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from brindle.llm import cdc_fingerprint, language_id, minhash, mixing, ngram_quality, piece_sampling, sharding, suffix_dedup, token_counts, weak_quality
from brindle.llm.queries import piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_sharding(docs, rows):
    out = sharding.shard_by_bytes(docs, 4).collect()
    assert len(out) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_sharding_balance_with_hot_group(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('hot', 30) else repeat(cast(id as string), 20) end as text")
    sizes = [r.b for r in sharding.shard_by_bytes(df, 8).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


def test_language(docs, rows, spark):
    model = language_id.fit(spark.createDataFrame([(f"the {i} thing and other words of the kind", "en") for i in range(30)] + [(f"der {i} und das ist nicht so schön", "de") for i in range(30)], "text string, lang string"))
    out = language_id.identify_languages(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    told = {r.text: r.lang_pred for r in language_id.identify_languages(spark.createDataFrame([("the other kind of words",), ("das ist nicht schön",)], "text string"), model).collect()}
    assert set(told.values()) == {"en", "de"}


@pytest.mark.parametrize("hot", [None, 1])
def test_suffix_dedup(spark, rows, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 2)
    unique = list(dict.fromkeys((r[0], r[1]) for r in rows if r[0] != 3))
    df = spark.createDataFrame(unique, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    seen = set()
    for doc_id, text in sorted(unique, key=lambda r: key(r[0])):
        raw = (text or "").encode()
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            covered[s : s + 100] |= w in seen
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~covered])
        spans = len(re.findall(b"\1+", covered.tobytes()))
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_awkward_rows(docs, rows):
    assert suffix_dedup.remove_repeats(docs).count() == len(rows)


def test_suffix_dedup_repeated_rows(spark, rows):
    a, b = rows[0][1], rows[1][1]
    once = [(1, a), (2, b + " " + a), (None, rows[11][1]), (3, "short")]
    remove = lambda r: {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(spark.createDataFrame(r, "doc_id long, text string").repartition(4)).collect()}
    got = remove([*once, *once, once[0]])
    assert got == remove(once)
    assert {x[0]: x[2] for x in got} == {1: 0, 2: len(a), None: 0, 3: 0}


def bag(t):
    w = words(t)
    return collections.Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def classes(rows):
    bags, least = [bag(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = sum((bags[i] & bags[j]).values())
        if bags[i] and bags[j] and shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
            least[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) if bags[i] else rows[i][0] for i in range(len(rows))]


def test_near_duplicates(docs, rows):
    got = collections.Counter((r.doc_id, r.text, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert got == collections.Counter((r[0], r[1], c) for r, c in zip(rows, classes(rows), strict=True))


@pytest.mark.parametrize("block", [5, 2048])
def test_near_duplicate_families(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng, rows = np.random.RandomState(3), []
    for _ in range(2):
        base = [f"w{x}" for x in rng.randint(0, 9999, 120)]
        for _ in range(30):
            t = list(base)
            for at in rng.randint(0, 120, rng.randint(0, 8)):
                t[at] = f"x{rng.randint(9999)}"
            rows.append((len(rows), " ".join(t)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[r[0]] for r in rows] == classes(rows)


def test_near_duplicates_seen_by_band_key(spark):
    """Low bytes that agree in earlier bands are no meeting there if the bands' keys differ."""
    keys = [[100 * node + band if band < 5 else band for band in range(minhash.BANDS)] for node in (1, 2)]
    shared = spark.createDataFrame([(5, 5, node, 2, node, bytes(minhash.COORDINATES), keys[node - 1]) for node in (1, 2)], "band long, no int, node long, n long, label long, sig binary, bands array<long>")
    bags = spark.createDataFrame([(node, list(range(50))) for node in (1, 2)], "node long, bag array<long>")
    assert [tuple(r) for r in minhash._other_links(shared, bags, 0.8, minhash.COORDINATES).collect()] == [(1, 2)]


def test_token_counts(docs, rows):
    model = piece_model()
    starts, inner = map(set, token_counts.vocabulary_of_pieces(model))

    def greedy(w):
        at, n = 0, 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (inner if at else starts)), None)
            if end is None:
                return 1, 1
            at, n = end, n + 1
        return n, 0

    for r in token_counts.count_pieces(docs, model).collect():
        found = [greedy(w) for w in words(r.text)]
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(found), sum(x[0] for x in found), sum(x[1] for x in found))


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    assert collections.Counter((r.doc_id, r.size) for r in out) == collections.Counter((r[0], len(words(r[1]))) for r in rows)
    total = sum(len(words(r[1])) for r in rows)
    assert abs(sum({r.source: r.target for r in out}.values()) - total) < 1e-6 * total
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        assert mine[0].target <= 3 * mine[0].source_size + 1e-6 and all(r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10
    taken = mixing.take(mixing.mix(docs))
    assert sum(len(words(r.text)) for r in taken.collect()) == sum(r.taken for r in out)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_small_sources(spark):
    big = [(i, "w " * 1000, "big") for i in range(200)]
    small = [(1000 + i, "s " * (5 + i % 40), f"small{i:02}") for i in range(60)]
    out = mixing.mix(spark.createDataFrame([*big, *small, (None, None, None)], "doc_id long, text string, source string"), block=1024).collect()
    by_source = collections.defaultdict(list)
    for r in out:
        by_source[r.source].append(r)
    for mine in by_source.values():
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and all((r.first_slot is None) == (r.taken == 0) for r in mine)
    slots = collections.defaultdict(set)
    for r in out:
        if r.taken:
            slots[r.first_slot].add(r.source)
    assert all(len(s) == 1 for s in slots.values())


def test_piece_sampling(docs, rows):
    model = piece_model()
    coded = piece_sampling.encode_sampled(docs, model)
    back = piece_sampling.decode_pieces(coded, model).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((r[0], r[1]) for r in rows)
    assert all(r.lossless for r in back if r.text is not None)
    again = {(r.doc_id, r.text): r.pieces for r in piece_sampling.encode_sampled(docs.repartition(7), model).collect()}
    assert all(again[r.doc_id, r.text] == r.pieces for r in coded.collect())


def test_quality(docs, rows):
    for r in ngram_quality.quality(docs).collect():
        w = words(r.text)
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, lines = set(), 0
        for line in (r.text or "").split("\n"):
            if words(line):
                lines += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), lines, len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_language_model_sums_to_one(spark):
    """After any context, known or not, the known code points and one unseen one share the whole probability."""
    rng = np.random.RandomState(1)
    alphabet = "abcdeé語 "
    docs = spark.createDataFrame([("".join(rng.choice(list(alphabet), 300)), "xx", 0)], "text string, lang string, half int")
    table = ngram_quality.hashed(ngram_quality.kneser_ney(ngram_quality.count_strings(docs))).toArrow()
    keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
    order = np.argsort(keys)
    for context in ("abc", "zzz", "語é ", "aaz"):
        texts = [(context + c).encode() for c in [*alphabet, "Q"]]
        hi, lo, _ = ngram_quality.strings_of(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        last = np.arange(3, len(hi), 4)
        assert abs(np.exp(ngram_quality.log_probabilities(hi[last], lo[last], (keys[order], values[order]))).sum() - 1) < 1e-4


def test_weak_quality(spark, docs, rows):
    assert weak_quality.weak_scores(docs).count() == len(rows)
    good = [(i, " ".join(f"word{j * i % 89} thing." if j % 9 == 0 else f"plain{j * i % 53}" for j in range(120))) for i in range(1, 200)]
    bad = [(1000 + i, " ".join(f"w{j * i % 31}###" for j in range(100))) for i in range(1, 50)]
    out = {r.doc_id: r.kept for r in weak_quality.weak_scores(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert np.mean([out[i] for i, _ in good]) > 0.95 and np.mean([out[i] for i, _ in bad]) < 0.05


def test_fingerprints(spark, rows):
    unique = sorted({r[0]: (r[0], r[1]) for r in rows}.values(), key=lambda r: key(r[0]))
    got = {r.doc_id: r for r in cdc_fingerprint.compare_edited(spark.createDataFrame(unique, "doc_id long, text string").repartition(4)).collect()}
    texts = [r[1] or "" for r in unique]
    for i, (doc_id, _) in enumerate(unique):
        t, following = texts[i], texts[(i + 1) % len(texts)]
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, new, nxt = cdc_fingerprint.chunk_sets([t.encode(), changed.encode(), following.encode()])
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (cdc_fingerprint.as_text(own), cdc_fingerprint.as_text(new))
        assert (r.near_edited, r.near_next) == (cdc_fingerprint.containment(own, new), cdc_fingerprint.containment(own, nxt))


def test_empty_tables(empty):
    model = piece_model()
    for out in (
        sharding.shard_by_bytes(empty), suffix_dedup.remove_repeats(empty), minhash.near_duplicates(empty), token_counts.count_pieces(empty, model), mixing.mix(empty),
        piece_sampling.encode_sampled(empty, model), ngram_quality.quality(empty), weak_quality.weak_scores(empty), cdc_fingerprint.compare_edited(empty),
        language_id.identify_languages(empty, language_id.fit(empty)),
    ):
        assert out.count() == 0


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    from .conftest import SCHEMA

    at = spark.createDataFrame(rows, SCHEMA).drop("size")
    at.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() > 0 and docs.where("not lossless").count() == 0
