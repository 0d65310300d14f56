"""The whole pipeline against a plain version: every stage in Python over what the one before kept."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
from test_llm_operators import WORD, brute_components, brute_seats, brute_stats, plain_mcd, spark_hash
from tokenizers import Tokenizer

import corpus_pipeline
from textengine.llm import langid, mcd, mixing


def made():
    """Rows (doc_id, text, lang, source) with copies, near copies, junk, repeated lines, nulls and texts without letters."""
    rng, rows = np.random.default_rng(21), []
    vocabulary = {x: ["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(150)] for x, letters in (("en", "etaoinshrdlu"), ("fr", "éàùçzyxwkqjv"))}
    for i in range(90):
        lang, source = ("en", "fr")[i % 2], f"s{i % 3}"
        words = [str(w) for w in rng.choice(vocabulary[lang], int(rng.integers(55, 70)))]
        rows.append((i, "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10)), lang, source))
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3]) for i in (3, 4, 10)]  # exact copies
    rows += [(210 + i, rows[i][1] + " more", rows[i][2], rows[i][3]) for i in (5, 6, 10)]  # near ones
    rows += [(300, "# $ % & | < > " * 40, "en", "s0"), (301, "ab " * 9, "en", "s1"), (302, "one two three four five six seven " * 12, "fr", "s2")]
    rows += [(303, None, "en", "s0"), (304, "", None, None), (305, " ".join(str(rng.integers(10**6)) for _ in range(60)), "en", "s1"), (306, rows[8][1][:200] + "\n" + "same line here\n" * 40, "en", "s1")]
    return [*rows, (None, rows[12][1].replace("a", "o"), None, "s1")]


def features(stat):
    words, chars, symbols, lines, dup, repeat = stat
    return np.array([math.log(1 + words), math.log(chars / max(words, 1) + 1), math.log(1 + 100 * symbols / max(chars, 1)), dup / max(lines, 1), repeat / max(words, 1)])


def plain_quality(rows):
    stats = {n: brute_stats(r[1]) for n, r in enumerate(rows)}
    fine = [n for n, s in stats.items() if s[0] >= 10 and 100 * s[5] <= 20 * s[0]]
    x = {n: features(stats[n]) for n in fine}

    def estimate(ids):
        return len(ids), *plain_mcd(np.array([x[n] for n in ids]))

    def lean(own, over):
        n, centre, cov = own
        w, apart = n / (n + 50.0), centre - over[0]
        return w * centre + (1 - w) * over[0], w * cov + (1 - w) * over[1] + w * (1 - w) * np.outer(apart, apart)

    top, kept = estimate(fine)[1:], []
    for group in {(rows[n][2], rows[n][3]) for n in fine}:
        mine = [n for n in fine if (rows[n][2], rows[n][3]) == group]
        of_lang = [n for n in fine if rows[n][2] == group[0]]
        centre, cov = lean(estimate(mine), lean(estimate(of_lang), top))
        inverse = np.linalg.inv(cov + np.diag(mcd._FLOORS))
        for n in mine:
            d = math.sqrt((x[n] - centre) @ inverse @ (x[n] - centre))
            assert abs(d - mcd.CUTOFF) > 0.12 * d + 0.05, "this table has no row at the cutoff itself"
            if d <= mcd.CUTOFF:
                kept.append(rows[n])
    return kept


def plain_language(rows):
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

    import zlib

    counts, docs = {}, Counter()
    for i, t, lang, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang is not None and t is not None:
            counts.setdefault(lang, Counter()).update(buckets(t))
            docs[lang] += bool(langid.letters(t))
    total = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    prior = {x: math.log((docs[x] + 1) / (sum(docs.values()) + len(counts))) for x in counts}
    kept = []
    for row in rows:
        found = buckets(row[1])
        if n := sum(found.values()):
            logs = {x: sum(k * math.log((counts[x][b] + 0.5) / total[x]) for b, k in found.items()) for x in counts}
            mean = {x: logs[x] / n * min(n, 50) + prior[x] for x in counts}
            best = max(counts, key=lambda x: logs[x] + prior[x])
            if math.exp(mean[best]) / sum(map(math.exp, mean.values())) >= 0.5:
                kept.append(row)
    return kept


def plain_mix(rows, block=8, shards=8, seed=17):
    """Copies of each row: how often the block of its middle word is among the seats of its source."""
    streams = {}
    for i, t, lang, source in rows:
        words = len(WORD.findall(t or ""))
        kept = (None if i is None else np.int64(i), lang, source)
        streams.setdefault(source, []).append((spark_hash(seed, t, *kept), words, (i, t, lang, source)))
    sizes, order = {s: sum(x[1] for x in v) for s, v in streams.items()}, sorted(s for s in streams if s is not None)
    order += [None] * (None in streams)
    weight, held, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        left = {s: w for s, w in weight.items() if s not in held}
        target = {**held, **{s: (total - sum(held.values())) * w / sum(left.values()) for s, w in left.items()}}
        if not (over := [s for s in left if target[s] > 3 * sizes[s]]):
            break
        held |= {s: 3 * sizes[s] for s in over}
    seats, out = brute_seats(target, sizes, block, shards)[-1], []
    for source, found in streams.items():
        blocks, at = max(1, -(-sizes[source] // block)), 0
        keys = [spark_hash(seed, source or "", r) % blocks for r in range(1, mixing._ROUNDS + 1)]
        for _, words, row in sorted(found, key=lambda x: x[:2]):
            place = (at + words // 2) // block
            for k in keys:
                partner = (k - place) % blocks
                place = partner if spark_hash(np.int64(max(place, partner)), np.int64(k)) & 1 else place
            out += [row] * (len(range(place, seats[source], blocks)) if words else 0)
            at += words
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    good = plain_quality(rows)
    named = plain_language(good)
    component = brute_components([(r[0], r[1]) for r in named if r[0] is not None])
    unique = [r for r in named if r[0] is None or component[r[0]] == r[0]]
    assert len(rows) > len(good) > len(unique) > 60 and {300, 301, 302, 303, 304}.isdisjoint(r[0] for r in good) and {203, 204, 215}.isdisjoint(r[0] for r in unique)
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t, lang, source in plain_mix(unique):
        e = library.encode(t, add_special_tokens=False)
        decoded = library.decode(e.ids, skip_special_tokens=False)
        want[i, source, lang, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
