"""The operators against brute-force versions, on rows with nulls, empty and long texts, ties,
repeated rows, clashing columns, and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textengine.llm import bpe, langid, lm_score, mcd, mixing, neardup, queries, sharding, stats, token_counts, token_files, winnow
from textengine.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, shard int, score string, n_words long, taken int"
LONG = " ".join(f"wörd{i % 977} and the rest, of it." for i in range(12_000))


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here to there again "
    texts = {
        1: base + "one two three four five", 2: base + "one two three four five", 3: base + "one two three four six", 4: None, 5: "", 6: "word", 7: "  \n\t ",
        8: "12345 !!! ###", 9: LONG, 10: "le chat est sur la table et la souris est dans la maison de la ville", 11: "the cat is on the table and the mouse is in the house of the town",
        12: "!!!!!! hahahaha <|endoftext|> İstanbul ΑΣ é x\x1cy ½ Ⅷ a b", 13: "a b a b a b a b a b a b a b a b", 14: "x",
    }
    out = []
    for i, t in texts.items():
        lang = None if i == 6 else "fr" if i == 10 else "en"
        out.append((i, t, lang, None if i in (5, 9) else f"s{i % 3}", None if t is None else len(t), 7, "no", 3, "x", 5, 1))
    return [*out, out[0], (None, "a row without an id has words", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in rows()]


def test_bpe_is_exact(docs, none):
    library = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe.encode_decode(docs, PATH).collect()), key=str)
    want = []
    for i, t in texts():
        e = library.encode(t or "", add_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(none, PATH).count() == 0
    one = bpe.encode_decode(docs.where("doc_id = 6"), PATH, with_text=True).first()
    assert one["ids"] == library.encode("word", add_special_tokens=False).ids


def test_pair_index_orders_overlaps_as_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.PairIndexBpe(PATH)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aabhn.!'"), rng.integers(1, 14))) for _ in range(800)]
    assert [library.encode(w, add_special_tokens=False).ids for w in words] == [own.encode(w) for w in words]


def test_bpe_equals_the_library_on_odd_characters():
    """Capitals and letters of new Unicode versions, combining marks, blanks, controls, contractions, special tokens."""
    rng = np.random.default_rng(8)
    library, own = Tokenizer.from_file(PATH), bpe.PairIndexBpe(PATH)
    spans = (0, 0x250), (0x300, 0x400), (0x1C80, 0x1C90), (0x2000, 0x2070), (0xA7C0, 0xA7F8), (0x10D40, 0x10D90), (0x16EA0, 0x16ED4), (0x3040, 0x3060)
    pool = [chr(c) for a, b in spans for c in range(a, b)] + list(" ab'sdßÉ<|>10\n") * 40
    texts = ["".join(rng.choice(pool, rng.integers(0, 40))) + str(rng.choice(["", "<|endoftext|>x", " it's we'll", "<|ENDOFTEXT|>"])) for _ in range(4000)]
    counts, shown = bpe.Encoder(own, ("words", "decoded")).run(bpe.pa.array(texts))
    at, ids = shown["words"][0] // 4, np.frombuffer(shown["words"][1], "<u4")
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == want.ids and counts[i] == len(want.ids)


def test_bpe_cache_over_batches_and_clashing_columns(docs, monkeypatch):
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe.PairIndexBpe(PATH), ("words",))
    monkeypatch.setattr(bpe, "CACHE_UNITS", 40)
    for k in range(30):
        texts = [f"word{k % 7} again {k} \u00a0x", None, ""]
        counts, shown = encoder.run(bpe.pa.array(texts))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and np.frombuffer(shown["words"][1], "<u4").tolist() == sum(want, [])
    named = docs.select("doc_id", "text", F.lit("mine").alias("n_tokens"), F.lit(1).alias("decoded"))
    got = bpe.encode_decode(named, PATH, keep=("doc_id", "n_tokens", "decoded"))
    assert got.columns == ["doc_id", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(got.dtypes)["n_tokens"] == "bigint"


def brute_stats(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    at = {}
    for j in range(len(words) - 4):
        at.setdefault(tuple(words[j : j + 5]), []).append(j)
    cover = {k + q for v in at.values() if len(v) > 1 for k in v for q in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(cover)


def test_statistics(docs, none):
    for _, t in texts():
        assert stats.text_stats(t) == brute_stats(t)
    got = {r["doc_id"]: r for r in mcd.quality(docs, keep=("doc_id", "text", "kept", "n_words")).collect()}
    assert got[4]["base_failed"] and got[13]["base_failed"] and not got[1]["base_failed"] and got[1]["kept"]
    assert mcd.quality(none).count() == 0


def test_outliers_are_robust(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join("".join(rng.choice(list("abcdef"), rng.integers(2, 8))) for _ in range(rng.integers(30, 90))) for _ in range(400)]
    junk = [" ".join("".join(rng.choice(list("abc#$%&|"), rng.integers(2, 8))) for _ in range(50)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in mcd.quality(df).where("kept").collect()}
    assert kept == set(range(400))


def test_repeated_lines_are_outliers(spark):
    """A document of repeated lines that passes the base rules is rejected, clean ones are kept."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.integers(2, 8)))
    lines = lambda n: [" ".join(word() for _ in range(4)) for _ in range(n)]
    clean = ["\n".join(lines(rng.integers(8, 22))) for _ in range(400)]
    copies = []
    for _ in range(10):
        same = lines(1)[0]
        # Lines between the copies keep runs of five words apart, as the base rules count those.
        copies.append("\n".join(x for fresh in lines(12) for x in (same, fresh)))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + copies)], "doc_id long, text string, lang string, source string")
    rows = mcd.quality(df).collect()
    assert not any(r["base_failed"] for r in rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == set(range(400))
    assert math.isclose(mcd.CUTOFF**2, 12.8325, rel_tol=1e-4)


def plain_mcd(x, h_share=0.75, starts=60):
    """Exact concentration steps on sorted distances from many starts: (centre, covariance) of least determinant."""
    rng, n, floors = np.random.default_rng(0), len(x), np.diag(mcd._FLOORS)
    h, best = math.ceil(h_share * n), None
    for k in range(starts):
        some = x if k == 0 else x[rng.choice(n, min(n, mcd.P + 1), replace=False)]
        centre, cov = some.mean(0), np.cov(some.T, bias=True) + floors
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(d, kind="stable")[:h]]
            was, centre, cov = cov, near.mean(0), np.cov(near.T, bias=True) * mcd._WIDEN + floors
            if np.allclose(was, cov, atol=1e-12):
                break
        if best is None or np.linalg.det(cov) < best[0] - 1e-15:
            best = np.linalg.det(cov), centre, cov - floors
    return best[1:]


def test_estimates_equal_plain_ones_at_every_size(spark):
    rng = np.random.default_rng(11)
    rows, n_of = [], {("en", "a"): 5, ("en", "b"): 30, ("en", None): 199, ("de", "a"): 200, ("de", "b"): 1000, (None, None): 40}
    for (lang, source), n in n_of.items():
        for i in range(n):
            words = int(np.exp(rng.normal(5 + 0.4 * (lang == "de"), 0.7))) + 30
            junk = rng.random() < 0.06
            chars, lines = int(words * rng.normal(9 if junk else 5.2, 0.3)), max(1, words // 9)
            rows.append((len(rows), lang, source, words, chars, int(chars * (0.3 if junk else abs(rng.normal(0, 0.004)))), lines, int(lines * abs(rng.normal(0, 0.03))), int(words * min(0.15, abs(rng.normal(0, 0.02))))))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in stats.NAMES))
    got = {r["doc_id"]: r for r in mcd.judge(df, mcd.fit(df)).collect()}
    features = {r["doc_id"]: np.array([r[f"x{i}"] for i in range(mcd.P)]) for r in mcd.with_features(df).collect()}
    lift = lambda ids: np.array([features[i] for i in ids])
    parent = {lang: plain_mcd(lift([r[0] for r in rows if r[1] == lang])) for lang in ("en", "de", None)}
    top, same, wrong = plain_mcd(lift([r[0] for r in rows])), 0, 0

    def lean(n, mine, over):
        w, apart = n / (n + 50.0), mine[0] - over[0]
        return w * mine[0] + (1 - w) * over[0], w * mine[1] + (1 - w) * over[1] + w * (1 - w) * np.outer(apart, apart)

    for (lang, source), n in n_of.items():
        ids = [r[0] for r in rows if (r[1], r[2]) == (lang, source)]
        of_lang = sum(m for (x, _), m in n_of.items() if x == lang)
        centre, cov = lean(n, plain_mcd(lift(ids)), lean(of_lang, parent[lang], top))
        inverse = np.linalg.inv(cov + np.diag(mcd._FLOORS))
        for i in ids:
            d = math.sqrt((features[i] - centre) @ inverse @ (features[i] - centre))
            assert abs(got[i]["distance"] - d) < 0.12 * d + 0.05
            # Verdicts may differ only at the cutoff itself: bulks are taken in bins of distance.
            assert got[i]["kept"] == (d <= mcd.CUTOFF) or abs(d - mcd.CUTOFF) < 0.15
            junk = rows[i][5] > 0.2 * rows[i][4]
            wrong += junk == got[i]["kept"]
    assert wrong < 0.03 * len(rows)


def test_kept_columns_named_like_features(spark, docs):
    named = docs.select("doc_id", "text", "lang", "source", F.lit("mine").alias("x0"), F.lit(7).alias("m1"), F.lit("a").alias("group"), F.lit(2).alias("n"))
    got = mcd.quality(named, keep=("doc_id", "x0", "m1", "group", "n", "lang"))
    assert {tuple(r)[1:5] for r in got.collect()} == {("mine", 7, "a", 2)} and got.columns[:6] == ["doc_id", "x0", "m1", "group", "n", "lang"]


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    want = brute_components([x for x in texts() if x[0] is not None])
    assert len(got) == len(rows())
    for r in got:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == want[r["doc_id"]]) and (r["doc_id"] is None or r["component_id"] == want[r["doc_id"]])
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"]} == {i: len(shingles(t)) for i, t in texts() if i}
    assert neardup.near_duplicates(none).count() == 0
    # A hot group around one original: copies are near it but seldom near each other.
    rng = np.random.default_rng(2)
    original = [f"w{i}" for i in range(200)]
    made = []
    for i in range(300):
        w = list(original)
        for k in rng.choice(200, rng.integers(0, 14), replace=False):
            w[k] = f"x{i}y{k}"
        made.append((1000 - i, " ".join(w)))
    made += [(2000 + i, " ".join(f"v{i}u{j}" for j in range(40))) for i in range(50)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(made)


def test_exact_links_in_blocks():
    import pandas as pd

    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64), np.arange(30, 130, dtype=np.uint64)]
    part = pd.DataFrame({"hashes": [s.tobytes() for s in sets], "label": [1, 2, 3, 4], "rep": [1, 2, 3, 4]})
    assert neardup._exact_links(80)(part)[["a", "b"]].to_numpy().tolist() in ([[1, 2]], [[2, 1]])


def test_pigeonhole_keys_find_all_within_the_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, 60, dtype=np.uint32)
    rows = [(0, 1, base.tobytes())]
    for i in range(1, 60):
        s = base.copy()
        s[rng.choice(60, neardup.ERRORS, replace=False)] += np.uint32(1)
        rows.append((i, 1, s.tobytes()))
    found = neardup.keys(spark.createDataFrame(rows, "rep long, n long, sig binary")).groupBy("key").agg(F.collect_set("rep").alias("r")).where(F.array_contains("r", 0)).select(F.explode("r").alias("rep")).distinct().count()
    assert found == 60


def test_shards(docs, none):
    got = sharding.shuffle_into_shards(docs, 4, cell_rows=2).collect()
    assert len(got) == len(rows()) and {r["size"] for r in got} == {7, None}
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) == 4
    assert sharding.shuffle_into_shards(none, 4).count() == 0
    rng = np.random.default_rng(4)
    draws = [sharding.draw_marked(rng, 2 * 10**9, 6 * 10**9, 400) for _ in range(2000)]
    assert abs(np.mean(draws) - 100) < 1.5 and abs(np.var(draws) - 75) < 12
    matrix = sharding.communication_matrix([10, 0, 25, 5], [14, 13, 13], 1)
    assert matrix.sum(1).tolist() == [10, 0, 25, 5] and matrix.sum(0).tolist() == [14, 13, 13]


def test_shards_are_a_uniform_shuffle(spark):
    """Every row lands in every shard and slot about equally often over seeds, whatever its partition."""
    rows, seen = spark.range(24).repartition(3).persist(), Counter()
    for seed in range(60):
        seen.update((r["id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(rows, 4, seed=seed, cell_rows=3).collect())
    by_shard = Counter()
    for (i, shard, slot), n in seen.items():
        assert slot < 6
        by_shard[i, shard] += n
    # 96 cells of 15 each: the statistic has about 72 degrees of freedom.
    assert sum((by_shard[i, s] - 15) ** 2 / 15 for i in range(24) for s in range(4)) < 120


def test_clashing_names_pass_through(docs):
    """Columns named like the operators' own working columns stay as they are."""
    named = docs.where("doc_id <> 9").select("doc_id", "text", F.lit("S").alias("s"), F.lit("C").alias("c"), F.lit("T").alias("start"), F.lit("O").alias("of"), F.lit("K").alias("__key"), F.lit("L").alias("__cell"), F.lit("N").alias("next_key"))
    want = {("S", "C", "T", "O", "K", "L", "N")}
    names = ["s", "c", "start", "of", "__key", "__cell", "next_key"]
    for out in (sharding.shuffle_into_shards(named, 3, cell_rows=2), winnow.with_next(named, "doc_id", {"body": F.coalesce("text", F.lit(""))}, cell_rows=3)):
        assert out.count() == len(rows()) - 2 and {tuple(r) for r in out.select(names).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids, vocab in ((rng.integers(0, 10, n), 10), (rng.zipf(1.3, n) % 49408, 49408), (np.full(n, 49407), 49408), (np.resize([5, 6, 7, 255], n), 300)):
        block = token_files.encode_block(ids, vocab)
        assert (token_files.decode_block(block) == ids).all()
        with pytest.raises(ValueError):
            token_files.decode_block(block[:-1] + bytes([block[-1] ^ 1]))
    assert len(token_files.encode_block(np.resize([5, 6, 7, 255], 4000), 49408)) < 3000


def test_coder_gains_on_real_documents(spark):
    """Orders 1 and 2 gain over order 0 (its entropy is a bound that knows all counts beforehand)."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toArrow().column(0).combine_chunks()
    ids = np.frombuffer(bpe.Encoder(bpe.PairIndexBpe(PATH), ("words",)).run(rows)[1]["words"][1], "<u4")
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    block = token_files.encode_block(ids, 49408)
    assert (token_files.decode_block(block) == ids).all()
    assert 8 * len(block) / len(ids) < 1.02 * -(share * np.log2(share)).sum()


def test_token_files(spark, docs, none):
    library, target = Tokenizer.from_file(PATH), f"{shared_dir(spark)}/token-test"
    some = docs.where("doc_id IS NOT NULL")
    token_files.write_files(some, target, PATH, block_tokens=50)
    got = sorted(tuple(r) for r in token_files.read_files(spark, target).collect())
    at, want = 0, []
    for i, t in sorted((x for x in texts() if x[0] is not None), key=lambda x: (x[0], x[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    token_files.write_files(none, target + "-none", PATH)
    assert token_files.read_files(spark, target + "-none").count() == 0
    token_files.write_files(docs, target + "-null", PATH)
    assert token_files.read_files(spark, target + "-null", with_ids=True).count() == len(rows())


def test_mix(spark, docs, none):
    got = mixing.mix(docs, keep=("doc_id", "text", "taken", "lang")).collect()
    assert len(got) == len(rows())
    sizes, target, taken = Counter(), {}, Counter()
    for r in got:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n
    plain = mixing.mix(docs, keep=("doc_id", "source")).collect()
    for r in plain:
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        left = {s: w for s, w in weight.items() if s not in held}
        want = {**held, **{s: (total - sum(held.values())) * w / sum(left.values()) for s, w in left.items()}}
        over = [s for s in left if want[s] > 3 * sizes[s]]
        if not over:
            break
        held |= {s: 3 * sizes[s] for s in over}
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= 16
    again = mixing.mix(docs.repartition(7), keep=("doc_id", "source"), cell_rows=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, plain))
    assert mixing.mix(none).count() == 0


def brute_seats(target, sizes, block_words, shards, limit=3):
    """Seats of each source in the first j + 1 shards, by awarding seat after seat to the highest quotient."""
    house, out = int(sum(sizes.values()) / block_words + 0.5), []
    order = sorted((s for s in target if s is not None)) + [None] * (None in target)
    won = dict.fromkeys(order, 0)
    for n in range(1, house + 1):
        free = [s for s in order if won[s] < limit * -(-sizes[s] // block_words) and target[s] > 0]
        if free:
            won[max(free, key=lambda s: target[s] / (2 * won[s] + 1))] += 1
        for j in range(len(out), shards):
            if n == house * (j + 1) // shards:
                out.append(dict(won))
    return out


def test_quotas_are_highest_quotients(spark):
    sizes = {"a": 500, "b": 100, "c": 900, None: 300, "d": 7, "e": 1}
    sources = mixing.with_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3)
    target = {r["source"]: r["target"] for r in sources.collect()}
    got = {(r["source"], r["shard"]): r for r in mixing.quotas(sources, 10, 3, 3).collect()}
    want = brute_seats(target, sizes, 10, 3)
    assert {k: r["upto"] for k, r in got.items()} == {(s, j): n for j, won in enumerate(want) for s, n in won.items()}
    by_shard = Counter()
    for (_, j), r in got.items():
        by_shard[j] += r["quota"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and sum(by_shard.values()) == round(sum(sizes.values()) / 10)


def spark_hash(*values):
    """xxhash64() of SQL over ints (as int), longs (as numpy) and strings; nulls are passed over."""
    import xxhash

    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if type(v) is int else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("shards", [1, 5])
def test_mix_equals_seat_by_seat(spark, docs, shards):
    some = docs.where("doc_id <> 9")  # the long text would be slow in plain Python
    block, seed, streams = 8, 17, {}
    for r in some.select("doc_id", "text", "source").collect():
        i = None if r["doc_id"] is None else np.int64(r["doc_id"])
        streams.setdefault(r["source"], []).append((spark_hash(seed, r["text"], i, r["source"]), len(WORD.findall(r["text"] or "")), str(r["doc_id"])))
    got = mixing.mix(some, shards=shards, keep=("doc_id", "source"), cell_rows=2).collect()
    target, sizes = {r["source"]: r["target"] for r in got}, {s: sum(x[1] for x in v) for s, v in streams.items()}
    upto, want = brute_seats(target, sizes, block, shards), []
    for source, rows in streams.items():
        rows.sort()
        owner = [n for n, (_, size, _) in enumerate(rows) for _ in range(size)]
        blocks = max(1, -(-len(owner) // block))
        keys = [spark_hash(seed, source or "", r) % blocks for r in range(1, mixing._ROUNDS + 1)]
        block_at = {}
        for b in range(blocks):
            x = b
            for k in keys:
                partner = (k - x) % blocks
                x = partner if spark_hash(np.int64(max(x, partner)), np.int64(k)) & 1 else x
            block_at[x] = b
        assert sorted(block_at) == list(range(blocks))
        taken = [[0] * shards for _ in rows]
        for t in range(upto[-1][source]):
            shard = next(j for j in range(shards) if t < upto[j][source])
            b = block_at[t % blocks]
            for n in owner[b * block : (b + 1) * block]:
                taken[n][shard] += 1
        want += [(rows[n][2], rows[n][1], str(taken[n]), sum(taken[n])) for n in range(len(rows))]
    assert sorted((str(r["doc_id"]), r["size"], str(r["shard_taken"]), r["taken"]) for r in got) == sorted(want)


def test_language_id(spark, docs, none):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, keep=("doc_id", "score")).collect()}
    assert got[10]["lang_pred"] == "fr" and got[11]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 7, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(docs, langid.fit(none)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict(none, model).count() == 0


def test_language_id_equals_a_plain_version(spark, docs):
    """Counts, priors, predictions and scores from dictionaries, one n-gram at a time."""
    mask, shift = 2**64 - 1, 64 - (langid.BUCKETS.bit_length() - 1)

    def buckets(text):
        t, out = langid.letters(text), Counter()
        for i in range(len(t)):
            code = 0
            for n in range(1, min(4, len(t) - i) + 1):
                code = (code * 0x100000001B3 + ord(t[i + n - 1]) + n) & mask
                mixed = code * 0x9E3779B97F4A7C15 & mask
                out[((mixed ^ (mixed >> 32)) * 0xC2B2AE3D27D4EB4F & mask) >> shift] += 1
        return out

    counts, n_docs, grams = {}, Counter(), {}
    for r in docs.select("text", "lang").collect():
        grams[r["text"]] = buckets(r["text"])
        if r["lang"] is not None and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(grams[r["text"]])
            n_docs[r["lang"]] += bool(langid.letters(r["text"]))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    prior = {x: math.log((n_docs[x] + 1) / (sum(n_docs.values()) + len(langs))) for x in langs}
    for r in langid.predict(docs, langid.fit(docs), keep=("doc_id", "text")).collect():
        found, n = grams[r["text"]], sum(grams[r["text"]].values())
        if not n:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {x: sum(k * math.log((counts[x][b] + 0.5) / total[x]) for b, k in found.items()) for x in langs}
        best = max(langs, key=lambda x: logs[x] + prior[x])
        mean = {x: logs[x] / n * min(n, 50) + prior[x] for x in langs}
        share = math.exp(mean[best]) / sum(map(math.exp, mean.values()))
        assert r["lang_pred"] == best and math.isclose(r["score"], share, abs_tol=1e-4)


def test_language_id_with_more_languages_than_a_block(spark, docs, monkeypatch):
    """Blocks of the matrix, carried from one to the next, give what one matrix gives."""
    many = docs.withColumn("lang", F.when(F.col("lang").isNotNull(), F.concat("lang", F.lit("-"), (F.col("doc_id") % 3).cast("string"))))
    keep = ("doc_id", "text", "lang", "best", "pred")
    rows = many.withColumns({"best": F.lit("mine"), "pred": F.lit(7)})
    model = langid.fit(many)
    order = lambda found: sorted(found.collect(), key=str)
    whole = order(langid.predict(rows, model, keep=keep))
    monkeypatch.setattr(langid, "LANGS", 1)
    assert model.n_langs > 3
    parts = order(langid.predict(rows, langid.fit(many), keep=keep))
    assert len(parts) == len(whole) == docs.count()
    for r, w in zip(parts, whole):
        assert tuple(r)[:6] == tuple(w)[:6] and math.isclose(r["score"], w["score"], rel_tol=1e-9) and (r["best"], r["pred"]) == ("mine", 7)
    model.drop()


def test_language_id_held_out(spark):
    out = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def brute_fingerprint(tokens, hashes, k, window):
    if len(tokens) < k or not hashes:
        return None
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        least = min(part)
        place = i + max(j for j, h in enumerate(part) if h == least)
        if (least, place) not in out:
            out.append((least, place))
    return out


def test_winnowing(spark, docs):
    k, window = 4, 10
    some = docs.where("doc_id IS NOT NULL AND doc_id <> 9").select("doc_id", "text")
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(winnow.TOKEN), F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), F.size("t") - k), lambda i: F.shiftright(F.xxhash64(*[F.get("t", i + j) for j in range(k)]), 28))
    rows = some.withColumn("t", tokens).withColumn("h", F.when(F.size("t") >= k, grams)).withColumn("f", winnow.positions(winnow.fingerprint(F.col("text")))).collect()
    for r in rows:
        want = brute_fingerprint(r["t"], r["h"], k, window)
        got = [(x["hash"], x["place"]) for x in r["f"]]
        assert got == want if want else len(got) == (1 if r["t"] else 0)
    near = queries.winnow.with_next(some, "doc_id", {"text": F.coalesce("text", F.lit(""))}, cell_rows=3).select("doc_id", "next_text").collect()
    # Repeated ids follow each other; the others have the next smaller id's text.
    by_id = dict(texts())
    ids = sorted({r["doc_id"] for r in near}, reverse=True)
    follow = {i: by_id[ids[(n + 1) % len(ids)]] or "" for n, i in enumerate(ids)}
    for i in ids:
        assert follow[i] in [r["next_text"] for r in near if r["doc_id"] == i]


def test_winnowing_without_blanks(spark):
    """A passage shared at any offset of a run without blanks is met; short words are cut as before."""
    rng = np.random.default_rng(6)
    run = lambda n: "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA5, n))
    passage = run(60)
    made = [(i, run(40 + i) + passage + run(40), run(40) + passage + run(40 + i)) for i in range(8)]
    f = lambda c: winnow.fingerprint(F.col(c))
    got = spark.createDataFrame(made, "i int, a string, b string").select("i", winnow.likeness(f("a"), f("b")).alias("near")).collect()
    assert all(r["near"] > 0.1 for r in got)
    words = " ".join("abcdefghijklmnopq"[:n] for n in range(1, 18))
    cut = spark.createDataFrame([(words,)], "t string").select(F.regexp_extract_all("t", F.lit(winnow.TOKEN), F.lit(0)).alias("t")).first()["t"]
    assert cut == [x for w in words.split() for x in (re.findall(r"\S{1,4}", w) if len(w) < 17 else w)]


def test_winnowing_query(spark, sf):
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(d, reverse=True)
    got = {r["doc_id"]: r for r in queries.op9_winnowing(spark, sf).collect()}
    for n, i in enumerate(ids):
        t, nxt = d[i], d[ids[(n + 1) % len(ids)]]
        m = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    marks = lambda text: {x.split("@")[0] for x in text.split()}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for n, i in enumerate(ids):
        own, after = marks(got[i]["fingerprint"]), marks(got[ids[(n + 1) % len(ids)]]["fingerprint"])
        assert math.isclose(got[i]["near_edited"], like(own, marks(got[i]["edited_fingerprint"]))) and math.isclose(got[i]["near_next"], like(own, after))
    assert sum(r["near_edited"] for r in got.values()) / len(d) > 0.4 and sum(r["near_next"] for r in got.values()) / len(d) < 0.05


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.pieces(path)
    floor, longest = min(scores.values()) - 10, max(map(len, scores))

    def count(word):
        best = [(0.0, 0)]
        for e, c in enumerate(word, 1):
            n = len(c.encode())
            options = [(best[e - 1][0] + floor * n, -(best[e - 1][1] + n))]
            options += [(best[s][0] + scores[word[s:e]], -(best[s][1] + 1)) for s in range(max(0, e - longest), e) if word[s:e] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    got = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path, keep=("doc_id", "n_words")).collect())
    cache = {}
    want = Counter()
    for i, t in texts():
        words = WORD.findall(t or "")
        want[(i, len(words), sum(cache.setdefault(w, count("▁" + w)) for w in words))] += 1
    assert got == want and token_counts.count_tokens(none, path).count() == 0


@pytest.mark.parametrize("range_bytes", [16 << 20, 40_000])
def test_lm_counts_are_whole(spark, docs, none, range_bytes):
    """Every word and bigram counts, also those seen once and words of any length; many chunks and ranges give what one gives."""
    long_word = spark.createDataFrame([(20, "x" * 70 + " rare", None), (21, "x" * 70 + " other", None)], "doc_id long, text string, lang string")
    some = docs.select("doc_id", "text", "lang").union(long_word).withColumn("target", F.col("doc_id") % 2 == 1)
    pairs, words = [Counter(), Counter()], [Counter(), Counter()]
    tokens = lambda t: ["", *WORD.findall((t or "").lower()), ""]
    for r in (everything := some.collect()):
        line = tokens(r["text"])
        for model in range(2 if r["target"] else 1):
            pairs[model].update(zip(line, line[1:]))
            words[model].update(line[1:])

    def loss(text, model):
        line, c = tokens(text), words[model]
        total, size = 0.0, sum(c.values()) + len(words[0]) + 1
        for h, w in zip(line, line[1:]):
            base = (c[w] + 1) / size
            total -= math.log(0.6 * pairs[model][h, w] / c[h] + 0.4 * base if c[h] else base)
        return total / (len(line) - 1)

    got = lm_score.score_all(some, keep=("doc_id", "text", "score"), range_bytes=range_bytes, cell_bytes=1000).collect()
    assert len(got) == len(everything)
    for r in got:
        want = loss(r["text"], 1), loss(r["text"], 0)
        assert r["n_words"] == len(tokens(r["text"])) - 2 and math.isclose(r["score"], want[0] - want[1], abs_tol=1e-5)
        assert math.isclose(r["target_loss"], want[0], rel_tol=1e-5) and math.isclose(r["background_loss"], want[1], rel_tol=1e-5)
    assert lm_score.score_all(none.withColumn("target", F.lit(True))).count() == 0
    by_id = {r["doc_id"]: r["score"] for r in lm_score.score_all(some.withColumn("target", F.col("doc_id") == 11)).collect()}
    assert by_id[11] < by_id[9]


def test_pipeline_stages(spark, docs, none):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (some, none.select(*some.columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            out.count()
            if name != "BPE encoding":
                assert out.columns == df.columns
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, some, "").collect()}
    want = brute_components([x for x in texts() if x[0] is not None])
    assert kept == {i for i, c in want.items() if i == c} | {None}


def test_pipeline_keeps_different_texts_of_one_id(spark):
    made = [(1, "one text with some words in it", "en"), (1, "another one without any relation at all", "en"), (1, "one text with some words in it", "de"), (2, "one text with some words in it", "en"), (None, "free", "en"), (None, "free", "en")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, df, "").select("doc_id", "text").collect()))
    assert len(got) == 4 and sum("one text" in x for x in got) == 1 and sum("another" in x for x in got) == 1
    again = corpus_pipeline.drop_near_duplicates(spark, df.repartition(3), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, df, "").collect()))


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
