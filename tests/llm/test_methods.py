"""The methods themselves against plain reference forms written here, and awkward columns for every operator."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import arrow_text, cdc_fingerprint, language_id, minhash, mixing, ngram_quality, piece_sampling, sharding, suffix_dedup, token_counts, weak_quality
from brindle.llm.queries import piece_model

from .conftest import passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names of results and of the operators' own columns.
PLANTED = (
    "_row _text _id _size _n _hash _key _range _tail _node _u _k _c _k1 _k2 _k3 _source _part _hot _copy _found doc node band label size shard slot law target taken takes first_slot "
    "n_bytes n_removed spans kept kept_text class_id n_links pieces n_pieces lossless n_words base_failed log2_perplexity votes posterior score lang_pred rejected fingerprint near_edited half block value"
).split()


def operators():
    model = piece_model()
    return {
        "sharding": sharding.shard_by_bytes, "suffix_dedup": suffix_dedup.remove_repeats, "minhash": minhash.near_duplicates, "token_counts": lambda d: token_counts.count_pieces(d, model),
        "mixing": mixing.mix, "piece_sampling": lambda d: piece_sampling.encode_sampled(d, model), "ngram_quality": ngram_quality.quality, "weak_quality": weak_quality.weak_scores,
        "cdc_fingerprint": cdc_fingerprint.compare_edited, "language_id": lambda d: language_id.identify_languages(d, language_id.fit(d)),
    }


@pytest.fixture(scope="module")
def planted(spark):
    long = " ".join(f"word{i * i % 99991}" for i in range(520_000))  # more than 5 MB
    rows = [(1, passage(1), "en", "a"), (1, passage(1), "en", "a"), (1, passage(2), "en", None), (None, passage(3), None, "a"), (None, None, "de", "b"), (None, None, "de", "b"), (7, long, "de", "b"), (8, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for i, name in enumerate(PLANTED):
        df = df.withColumn(name, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df.cache(), rows


@pytest.mark.parametrize("name", sorted(operators()))
def test_awkward_columns(planted, name):
    df, rows = planted
    out = operators()[name](df)
    same = out.columns[: out.columns.index("value") + 1]  # the last planted name; results follow
    assert len(out.columns) == len({c.lower() for c in out.columns}) and {"_row", "_text", "_id", "_n", "doc"} <= set(same)
    carried = out.select(*[F.col(f"`{c}`") for c in same]).collect()
    assert collections.Counter(r.doc_id for r in carried) == collections.Counter(r[0] for r in rows)
    for r in carried:
        assert all(r[c] == f"{PLANTED.index(c)}-{'none' if r.doc_id is None else r.doc_id}" for c in same if c in PLANTED)
    assert len(out.collect()) == len(rows)


@pytest.mark.parametrize("doc_id,want", [(0, None), (17, None), (None, False), (123456789, None)])
def test_held_out(spark, doc_id, want):
    got = spark.createDataFrame([(doc_id,)], "doc_id long").select(language_id.held_out().alias("h")).first().h
    assert got == (zlib.crc32(str(doc_id).encode()) % 3 == 1 if want is None else want)


def test_language_reference(spark):
    """Frequencies, vectors, cosine and rejection written out plainly for one centroid a language."""
    texts = [(i, f"the {'other ' * (i % 3)}thing number and words of kind {i}", "en") for i in range(25)] + [(100 + i, f"das {'andere ' * (i % 4)}ding und nicht schön {i}", "de") for i in range(25)]
    train = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.fit(train, dims=1 << 12, clusters=1)

    def grams(t):
        out, c = collections.Counter(), ["", *(x if x.isalpha() else "" for x in t.lower()), ""]
        for i in range(1, len(c) - 1):
            if c[i]:
                out[(c[i], c[i + 1])] += 1
                out[(c[i - 1], c[i], c[i + 1], 3)] += 1
        return out

    n = len(texts)
    df = collections.Counter(itertools.chain.from_iterable(set(grams(t[1])) for t in texts))

    def vector(t):
        v = {g: math.log1p(k) * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in grams(t).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / size for g, x in v.items()}

    def centroid(lang):
        total = collections.Counter()
        for t in {t[1] for t in texts if t[2] == lang}:
            for g, x in vector(t).items():
                total[g] += x
        size = math.sqrt(sum(x * x for x in total.values()))
        return {g: x / size for g, x in total.items()}

    centroids = {lang: centroid(lang) for lang in ("de", "en")}
    probes = ["the words of another kind", "und das ding ist nicht da", "qzx wvk jyq", "12 34 !!", None, "the ding and das thing"]
    got = language_id.identify_languages(spark.createDataFrame([(p,) for p in probes], "text string"), model).collect()
    for r in got:
        v = vector(r.text or "")
        cosine = {lang: sum(x * c.get(g, 0) for g, x in v.items()) for lang, c in centroids.items()}
        if not any(x.isalpha() for x in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        best = max(sorted(cosine), key=cosine.get)
        assert abs(r.score - cosine[best]) < 0.03 and (r.lang_pred == best or abs(cosine["de"] - cosine["en"]) < 0.03)
        assert r.rejected == (r.score < model.threshold[model.langs.index(r.lang_pred)])
    assert {r.text for r in got if r.rejected} >= {"qzx wvk jyq", "12 34 !!", None}


def test_merged_transforms():
    """Rows in intervals of a common prefix of `length` are those suffixes that share it in the sorted list, and the histogram counts its splits."""
    rng = np.random.RandomState(5)
    for length in (3, 6):
        shards, suffixes, at = [], [], 0
        for _ in range(4):
            strings = ["".join(rng.choice(list("abc"), rng.randint(4, 30))) for _ in range(5)]
            raw = np.frombuffer(("\0".join(strings) + "\0").encode(), np.uint8).astype(np.int64)
            raw = np.where(raw == 0, 0, raw + 1).astype(np.uint8)
            shards.append((raw, len(strings)))
            for s in strings:
                suffixes += [(s[i:], at + i) for i in range(len(s))]
                at += len(s) + 1
        position, interval, prefixes = suffix_dedup.merge_transforms(shards, length)
        want = collections.defaultdict(set)
        for s, p in suffixes:
            if len(s) >= length:
                want[s[:length]].add(p)
        got = collections.defaultdict(set)
        for p, i in zip(position.tolist(), interval.tolist(), strict=True):
            got[i].add(p)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
        assert prefixes.sum() > 0


def test_suffix_dedup_whole_fixture(docs, rows):
    """Byte for byte on every row of the fixture, repeated rows and ids included."""
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    texts = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (-1 if r[0] is None else r[0], 0))
    ties = [list(g) for _, g in itertools.groupby(texts, key=lambda r: r[0])]
    for order in itertools.product(*[list(itertools.permutations(g)) for g in ties]):  # rows of one id come in the order of a hash
        seen, want = set(), {}
        for doc_id, text in itertools.chain.from_iterable(order):
            raw = (text or "").encode()
            covered = np.zeros(len(raw), bool)
            for s in range(len(raw) - 99):
                covered[s : s + 100] |= raw[s : s + 100] in seen
                seen.add(raw[s : s + 100])
            kept = bytes(np.frombuffer(raw, np.uint8)[~covered])
            want[doc_id, text] = (doc_id, len(raw), int(covered.sum()), len(re.findall(b"\1+", covered.tobytes())), hashlib.sha256(kept).hexdigest())
        if got == collections.Counter(want[r[0], r[1]] for r in rows):
            return
    raise AssertionError("no order of the rows of one id gives these results")


@pytest.mark.parametrize("block", [1, 7, 100])
def test_mixing_by_slots(docs, rows, block):
    """Every source's blocks are dealt to the golden-ratio slots in order, and a document gives what its slots take."""
    out = mixing.mix(docs, block=block).collect()
    by_source = collections.defaultdict(list)
    for r in out:
        by_source[r.source].append(r)
    blocks = {s: -(-int(mine[0].target + 0.5) // block) for s, mine in by_source.items()}
    total = sum(blocks.values())
    step = mixing.golden_step(total)
    assert math.gcd(step, total) == 1
    slots, edges, at = collections.defaultdict(list), {}, 0
    for s in sorted(blocks, key=lambda s: (s is None, s or "")):
        edges[s] = (at, at + blocks[s])
        at += blocks[s]
    for i in range(total):
        slots[next(s for s, (lo, hi) in edges.items() if lo <= i * step % total < hi)].append(i)
    for s, mine in by_source.items():
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5)
        taken = [(t.slot, t.words) for r in mine for t in r.takes]
        assert all(slot in slots[s] for slot, _ in taken) and all(r.first_slot == min((t.slot for t in r.takes), default=None) for r in mine)
        assert {r.taken for r in mine if r.taken != sum(t.words for t in r.takes)} == set()
        # in slot order the takes fill the stream: what is taken before a slot's block is at least its rank's start less a block
        ranks = {slot: k for k, slot in enumerate(slots[s])}
        laid = 0
        for slot, words in sorted(taken, key=lambda x: ranks[x[0]]):
            assert ranks[slot] * block - max(w for _, w in taken) * 6 <= laid + block
            laid += words


def test_golden_points_are_even():
    n = 10_007
    step = mixing.golden_step(n)
    points = np.arange(n) * step % n
    assert len(set(points.tolist())) == n
    for prefix in (100, 1000, 5000):
        share = (points[:prefix] < n // 3).mean()
        assert abs(share - 1 / 3) < 4 / prefix * 3



def test_sampling_law():
    """Frequencies of sampled segmentations of a word follow the products of the piece weights, by enumeration."""
    pieces = piece_sampling.Pieces(piece_model(), sharpness=0.3)
    word = " the"
    names = {}
    for i, raw in enumerate(pieces.bytes):
        names.setdefault(raw.decode("utf-8", "ignore"), []).append(i)
    weight = {int(i): float(w) for i, w in zip(pieces.ids, pieces.weights, strict=True) if i >= 0}

    def segmentations(text):
        if not text:
            yield (), 1.0
        for k in range(1, len(text) + 1):
            for i in names.get(text[:k], []):
                if i in weight:
                    for rest, p in segmentations(text[k:]):
                        yield (i, *rest), weight[i] * p

    want = dict(segmentations(word))
    total = sum(want.values())
    n = 40_000
    raw, offsets = (word * n).encode(), np.arange(n + 1) * len(word)
    ids, counts = piece_sampling.sample(raw, offsets, np.arange(n, dtype=np.int64) * 7919 + 3, pieces)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(bounds))
    assert set(got) <= set(want) and len(want) > 3
    for s, p in want.items():
        p /= total
        assert abs(got[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def reference_model(counts, order):
    """Interpolated modified Kneser-Ney over strings, written from its definition."""
    c = {order: counts}
    for k in range(order - 1, 0, -1):
        c[k] = collections.Counter(s[1:] for s in c[k + 1])
    uniform = 1 / (len(c[1]) + 1)
    discounts = {}
    for k in c:
        n = [0] + [max(1, sum(v == i for v in c[k].values())) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        discounts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.05) for i in (1, 2, 3)]

    def p(s):
        k = len(s)
        if not k:
            return uniform
        ctx = {x: v for x, v in c[k].items() if x[:-1] == s[:-1]}
        if not ctx:
            return p(s[1:])
        total = sum(ctx.values())
        off = {x: discounts[k][min(v, 3)] for x, v in ctx.items()}
        return max(ctx.get(s, 0) - off.get(s, 0), 0) / total + sum(off.values()) / total * p(s[1:])

    return p


def test_kneser_ney(spark):
    rng = np.random.RandomState(2)
    texts = ["".join(rng.choice(list("abcdé語 "), rng.randint(5, 60), p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.05, 0.15])) for _ in range(30)]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    halves = {r.text: r.h for r in docs.select("text", ngram_quality.half_of(F.col("text")).alias("h")).collect()}
    got = {r.text: r.log2_perplexity for r in ngram_quality.quality(docs).collect()}
    models = {}
    for half in (0, 1):
        counts = collections.Counter()
        for t in texts:
            if halves[t] != half:
                counts.update(("\0" * 3 + t)[i : i + 4] for i in range(len(t)))
        models[half] = reference_model(counts, 4)
    for t in texts:
        want = -sum(math.log2(models[halves[t]](("\0" * 3 + t)[i : i + 4])) for i in range(len(t))) / len(t)
        assert got[t] is None if not WORD.findall(t) else abs(got[t] - want) < 1e-4


def test_quality_bands_and_blocks(spark):
    rng = np.random.RandomState(8)
    vocabulary = {lang: ["".join(rng.choice(list(letters), rng.randint(2, 8))) for _ in range(150)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), (None, "qrstuvwx"))}
    rows = [(i * 10 + j, " ".join(rng.choice(vocabulary[lang], 80)), lang) for j, lang in enumerate(vocabulary) for i in range(60)]
    rows += [(9001, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 500)) + " x" * 0, "aa"), (9002, " ".join(rng.choice(vocabulary["bb"], 80)), "aa"), (9003, None, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = ngram_quality.quality(df).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, ngram_quality.quality(df, most_entries=0).collect()))
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[i] for i in (9001, 9002, 9003)) and np.mean([kept[r[0]] for r in rows[:-3]]) > 0.97
    for lang in vocabulary:
        mine = [r for r in out if r.lang == lang and not r.base_failed and r.log2_perplexity is not None]
        steps = sorted(math.floor(r.log2_perplexity * 256) for r in mine)
        q1, q3 = (steps[math.ceil(q * len(steps)) - 1] / 256 for q in (0.25, 0.75))
        width = max(q3 - q1, 1 / 256)
        assert all(abs(r.band_low - (q1 - 3 * width)) < 1e-9 and abs(r.band_high - (q3 + 3 * width + 1 / 256)) < 1e-9 for r in mine)


def test_estimated_accuracies():
    """Simulated independent voters with one fault each: the estimate gives back how often they vote and who is good."""
    rng = np.random.RandomState(4)
    k, n, share = len(weak_quality.LABELLERS), 40_000, 0.8
    good = rng.rand(n) < share
    right = rng.uniform(0.75, 0.95, k)  # of good documents this share is voted good
    found = rng.uniform(0.45, 0.7, k)  # of bad documents this share is voted bad
    u = rng.rand(n, k)
    votes = np.where(good[:, None], np.where(u < right, weak_quality.GOOD, weak_quality.NONE), np.where(u < found, weak_quality.BAD, np.where(u < found + 0.2, weak_quality.GOOD, weak_quality.NONE)))
    codes = weak_quality.pattern_codes(votes)
    patterns, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    posterior, rates, estimated = weak_quality.estimate(patterns, counts)
    assert abs(estimated - share) < 0.02
    assert np.abs(rates[:, 1, weak_quality.GOOD] - right).max() < 0.03 and np.abs(rates[:, 0, weak_quality.BAD] - found).max() < 0.03
    assert ((posterior[back] > 0.5) == good).mean() > 0.99


def plain_chunks(raw):
    """Content-defined chunks one byte at a time."""
    m = 1 << 32
    out, start = {}, 0
    while start < len(raw):
        end = start
        while True:
            end += 1
            size = end - start
            if end == len(raw) or size == cdc_fingerprint.MOST:
                break
            if size <= cdc_fingerprint.LEAST:
                continue
            h = sum(int(cdc_fingerprint._GEAR[raw[end - 1 - j]]) << j for j in range(cdc_fingerprint.WINDOW)) % m
            if h & int(cdc_fingerprint.STRICT if size <= cdc_fingerprint.NORMAL else cdc_fingerprint.LOOSE) == 0:
                break
        piece = raw[start:end]
        out[hashlib.blake2b(piece, digest_size=cdc_fingerprint.DIGEST_BYTES).digest()] = len(piece)
        start = end
    return out


def test_plain_chunks(rows):
    texts = [(r[1] or "").encode() for r in rows]
    assert cdc_fingerprint.chunk_sets(texts) == [plain_chunks(t) for t in texts]


def test_fingerprints_of_repeated_ids(spark, rows):
    """Every row of a fixture in which a third of the rows share an id and a third have none, compared with its next one."""
    texts = [passage(100 + i, 5 + i % 40) for i in range(60)]
    data = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    got = {(r.doc_id, r.text): r for r in cdc_fingerprint.compare_edited(df).collect()}
    assert len(got) == len(data)
    for (doc_id, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        r = got[doc_id, t]
        own, new, nxt = (plain_chunks(x.encode()) for x in (t, changed, following))
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == sum(w for d, w in own.items() if d in new) / sum(own.values())
        assert r.near_next == sum(w for d, w in own.items() if d in nxt) / sum(own.values())
    short = [r for r in got.values() if r.n_chars < 200]
    assert short and np.mean([r.near_edited for r in short]) > 0.5


def test_spread_join(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, if(id % 50 = 1, null, id)) as k", "id as v")
    table = spark.range(0, 4000).selectExpr("id as k", "id * 2 as w")
    for how in ("left", "inner"):
        got = sorted(map(repr, arrow_text.spread_join(rows, table, "k", "v", how).select("k", "v", "w").collect()))
        assert got == sorted(map(repr, rows.join(table, "k", how).select("k", "v", "w").collect()))


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input: what goes and what stays."""
    import corpus_pipeline as p

    english, german = ("the and of that with from this have not which are was").split(), ("der die das und nicht mit von auf ist ein eine sich").split()
    rng = np.random.RandomState(1)
    text = lambda words, n: " ".join(rng.choice(words, n).tolist() + [f"{x:x}" for x in rng.randint(1 << 20, 1 << 30, 3)])
    rows = [(i, text(english, 60), "en", "a") for i in range(40)] + [(100 + i, text(german, 60), "de", "b") for i in range(40)]
    common = " ".join(rng.choice(english, 70))
    rows += [(200, rows[0][1], "en", "c"), (201, rows[0][1] + " more", "en", "c"), (202, "жук щёл цап хрю", None, "c"), (203, None, "en", "c"), (204, text(english, 30) + " " + common, "en", "c"), (205, text(english, 30) + " " + common, "en", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    by_name = dict(p.STAGES)
    found = {r.doc_id: r for r in by_name["language_id"](spark, docs, "").collect()}
    assert set(found) == {r[0] for r in rows} - {202, 203} and all(found[r[0]].lang == r[2] for r in rows if r[0] in found)
    near = {r.doc_id for r in by_name["near_dedup"](spark, docs, "").collect()}
    assert near == {r[0] for r in rows} - {200, 201}
    kept = {r.doc_id: r.text for r in by_name["suffix_dedup"](spark, docs.where("doc_id <> 200 and doc_id <> 201"), "").collect()}
    assert common in kept[204] and common not in kept[205] and kept[1] == rows[1][1] and kept[203] is None
    mixed = by_name["mixing"](spark, docs, "")
    decided = {(r.doc_id): r.taken for r in mixing.mix(docs, carry=["doc_id"]).collect()}
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert taken == collections.Counter({k: v for k, v in decided.items() if v})
    coded = by_name["piece_sampling"](spark, docs, "")
    back = {r.doc_id: r.text for r in piece_sampling.decode_pieces(coded, piece_model()).collect()}
    assert back == {r[0]: r[1] for r in rows}


def test_distinct_keys():
    rng = np.random.RandomState(3)
    for keys in (rng.randint(0, 50, 1000), rng.randint(0, 1 << 62, 5000), np.zeros(3, int), np.zeros(0, int), np.arange(1 << 12) << 5):
        keys = arrow_text.mix64(keys.astype(np.uint64)) if len(keys) != 1 << 12 else keys.astype(np.uint64)
        one, which = ngram_quality.distinct(keys)
        assert len(one) == len(np.unique(keys)) and (keys[one][which] == keys).all()
