"""The pipeline's stages against plain Python, and one very long text through every operator."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bitplanes, jaccard, mixing, packing, pii, quality_classifier, quality_rules, secrets, token_counts
from sparkloom.llm._common import new_path
from sparkloom.llm.quality_rules import COMMON_WORDS
from tests.llm.test_operators import BYTE_BPE, WORD_BPE, library, plain_pii, plain_secrets

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def plain_features(text):
    """The classifier's statistics, in plain Python."""
    t = text or ""
    w = WORD.findall(t)
    joined, n, chars = "".join(w), max(len(w), 1), max(len(t), 1)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    repeated = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    known = {x for v in COMMON_WORDS.values() for x in v}
    per = lambda p: len(re.findall(p, t)) / chars
    return {
        "log_words": math.log1p(len(w)), "mean_word": len(joined) / n, "upper": per("[A-Z]"), "digit": per("[0-9]"), "other": per(r"[^\x00-\x7F]"), "mark": per(r"[.,;:?'\"()-]"),
        "symbol": per("[#*$%&|<>]"), "bang": per("!"), "space": (len(t) - len(joined)) / chars, "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeats": len(repeated) / n,
        "distinct": len(set(w)) / n, "common": sum(x.lower() in known for x in w) / n, "line_words": math.log1p(len(w) / max(len(lines), 1)), "bars": w.count("|") / n,
    }


def test_quality_stage_against_plain_python(spark, docs):
    import corpus_pipeline as p

    model = quality_classifier.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert model.rules
    rows = docs.collect()
    x = np.array([[plain_features(r.text)[f] for f in quality_classifier.FEATURES] for r in rows])
    want = {r.doc_id for r, s in zip(rows, model.score(x)) if s >= 0.7}
    got = p.quality(spark, docs, DATA).collect()
    assert {r.doc_id for r in got} == want and len(got) == sum(r.doc_id in want for r in rows) < len(rows)


def test_mixture_stage_against_plain_python(spark, docs):
    import corpus_pipeline as p

    rows = docs.collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    names = sorted({r.source for r in rows if r.source is not None}) + [None] * any(r.source is None for r in rows)
    whole = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in names}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(whole.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * whole[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * whole[s] for s in full}
        left -= sum(2.0 * whole[s] for s in full)
        free -= full
    keyed = docs.select(*p.COLUMNS).withColumn("row", F.xxhash64(*p.COLUMNS))
    keys = {r.doc_id: r.key for r in mixing.weighted_rows(keyed, keep=("row",)).collect()}
    want = Counter()
    for s in names:
        epochs = int(target[s] / whole[s] + 1e-12) if whole[s] else 0
        rest = round(target[s] - epochs * whole[s])
        for r in sorted((r for r in rows if r.source == s), key=lambda r: keys[r.doc_id]):
            part = min(size[r.doc_id], max(rest, 0))
            rest -= part
            if size[r.doc_id]:
                want[r.doc_id] += math.ceil((epochs * size[r.doc_id] + part) / size[r.doc_id])
    got = Counter(r.doc_id for r in p.mixture(spark, docs, DATA).select("doc_id").collect())
    assert got == +want


def test_packed_stage_against_the_library(spark, docs):
    import corpus_pipeline as p

    rows = docs.limit(60)
    got = p.packed(spark, rows, DATA).toPandas()
    for r in rows.collect():
        ids = [*library(WORD_BPE, r.text), 1]
        g = got[got.doc_id == r.doc_id].sort_values("start")
        assert g.length.sum() == len(ids) and g.start.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist()
        assert g.ids_crc32.tolist() == [zlib.crc32(np.asarray(ids[a : a + n], "<u4").tobytes()) for a, n in zip(g.start, g.length)]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist() and g.length.sum() <= 2048


def test_a_text_of_megabytes(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    body = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(300_000))
    text = body + ' Mail a.b@c.de +1 (499) 555-6503 token = "' + "Ab1" * 6 + '" 0123456789abcdef'
    assert len(text) > 2_000_000
    rows = [(1, text, "en", "s", len(text)), (2, "a short text of seven words in all", "en", "s", 30), (3, text + " end", "en", "t", len(text)), (4, "x" * 1_000_000, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    texts = {r[0]: r[1] for r in rows}
    n_words = {k: len(WORD.findall(t)) for k, t in texts.items()}
    byte_ids = {k: len(library(BYTE_BPE, t)) for k, t in texts.items()}
    word_ids = {k: library(WORD_BPE, t) for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, BYTE_BPE).collect()} == byte_ids
    path = new_path(spark, "long")
    bitplanes.write_ids(df, WORD_BPE, path)
    assert {r.doc_id: r.ids[:-1] for r in bitplanes.read_ids(spark, path).collect()} == word_ids
    got = packing.pack_documents(df, WORD_BPE).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) + 1 for k, v in word_ids.items()}
    for r in pii.find_pii(df, pii.fit(df)).collect():
        # The plain patterns are quadratic on a run of a million letters; it holds nothing.
        plain = plain_pii(texts[r.doc_id]) if r.doc_id != 4 else []
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    names = ("assign", "access", "hex")
    for r in secrets.digest(df).collect():
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in plain_secrets(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == n_words
    assert {r.doc_id: r.n_words for r in quality_rules.judge(df).collect()} == n_words
    x = {r.doc_id: r for r in quality_classifier.statistics(df, keep=("doc_id",)).collect()}
    assert all(x[k]["f_repeats"] == pytest.approx(plain_features(t)["repeats"]) for k, t in texts.items())
    sets = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(df).collect()}
    assert sets[1][1] == sets[3][1] == 1 and sets[2] == (4, 2) and sets[4] == (1, 4)
    w = WORD.findall(text)
    assert sets[1][0] == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
