"""Registered queries against their SQL, and the pipeline's stages against what each promises."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import CLASHES, DOCS, base_by_hand, best_by_hand, components, repeated_by_hand, score_of, shingle_sets, targets_by_hand
from tests.oracle import agree
from vellum.llm import common, minhash, mixing, quality, queries, secrets, sentencepiece


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    agree(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in kept]
    assert ids[1] == sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert ids[2] == sorted(r.doc_id for r in minhash.classes(kept[1]).where("kept").collect())
    assert ids[3] == ids[2]
    assert secrets.scan(kept[3], secrets.trained(kept[2], sf_dir)).where(F.size("base") > 0).count() == 0
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert ids[4] == sorted(d for d, n in copies.items() for _ in range(n))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    back = sentencepiece.decode(kept[5]).collect()
    assert len(back) == len(ids[4]) and all(texts[r.doc_id] == r.text for r in back)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == ids[4]


def rules_by_hand(rows):
    """(doc_id, text, source) that stay, with the texts that are left."""
    even = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    of_host, count = {}, {}
    for _, text, host in rows:
        lines = frozenset(filter(None, map(even, (text or "").split("\n"))))
        if lines and lines not in of_host.setdefault(host, set()):
            of_host[host].add(lines)
            for x in lines:
                count[host, x] = count.get((host, x), 0) + 1
    bad = {k for k, n in count.items() if n > max(10, 0.1 * len(of_host[k[0]]))}
    out = []
    for i, text, host in rows:
        words = re.findall(common.WORD, text or "")
        left = [x for x in (text or "").split("\n") if (host, even(x)) not in bad]
        rest = len(re.findall(common.WORD, "\n".join(left)))
        if len(words) >= 20 and 100 * repeated_by_hand(words) <= 30 * len(words) and rest >= 10 and rest >= 0.2 * len(words):
            out.append((i, "\n".join(left), host))
    return out


def redacted_by_hand(text, model):
    spans = [tuple(map(int, s.split(":")[1:])) for s in filter(None, base_by_hand(text).split(","))]
    random = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        at = [secrets.ALPHABET.index(c) + 1 for c in m[0]]
        score = sum(round(model.weights[p * (len(secrets.ALPHABET) + 1) + c], 6) for p, c in zip([0, *at], at))
        if re.search("[A-Za-z]", m[0]) and score > secrets.MARGIN and all(b <= m.start() or a >= m.end() for a, b in spans):
            random.append(m.span())
    gone = bytearray(len(text))
    for a, b in spans + random:
        gone[a:b] = b"\1" * (b - a)
    return re.sub("\0+", "[secret]", "".join("\0" if g else c for c, g in zip(text, gone)))


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    """The documents, with rows that repeat an id in other sources, rows without one, copies, and columns of clashing names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = docs.where("doc_id % 3 = 0").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7)).withColumn("source", F.lit("again")).withColumn("text", F.concat(F.lit("Begins in another way altogether: "), "text"))
    rows = [(None, "short", "en", None, 5)] * 30 + [(None, None, None, None, None), (5, "", "en", "", 0)]
    rows += [(None, "a text of more than twenty words, which come once each, so that no rule for words or lines rejects it, here for a nameless row " + w, "en", None, 1) for w in ("one", "one", "two")]
    return docs.unionByName(more).unionByName(spark.createDataFrame(rows, DOCS)).withColumns({c: F.lit(1) for c in CLASHES})


def test_stages_against_plain_python(spark, sf_dir, tmp_path, made):
    kept, model = [made], None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "secret scan":
            model = secrets.trained(kept[-1], sf_dir)
        stage(spark, kept[-1], sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    assert all(df.columns == made.columns for df in kept[:5])
    rows = [[(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()] for df in kept[:5]]
    assert Counter(rows[1]) == Counter(rules_by_hand(rows[0]))
    assert all(r.n_chars == len(r.text) for r in kept[1].select("text", "n_chars").collect())
    # Of each class one row, of the smallest id if it has one.
    sets = shingle_sets([r[:2] for r in rows[1]])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    classes = {}
    for r, c in zip(rows[1], components(len(sets), links)):
        classes.setdefault(c, []).append(r)
    heads = [min((r[0] is None, r[0] or 0) for r in c) for c in classes.values()]
    assert Counter((r[0] is None, r[0] or 0) for r in rows[2]) == Counter(heads) and not Counter(rows[2]) - Counter(rows[1])
    assert Counter(rows[3]) == Counter((i, redacted_by_hand(t, model), s) for i, t, s in rows[2])
    # Copies of whole rows, three at most, near their sources' targets.
    size = lambda t: len(re.findall(common.WORD, t))
    before, after = Counter(rows[3]), Counter(rows[4])
    assert set(after) <= set(before) and all(n <= 3 * before[r] for r, n in after.items())
    sizes, taken = Counter(), Counter()
    for _, t, s in rows[3]:
        sizes[s] += size(t)
    for _, t, s in rows[4]:
        taken[s] += size(t)
    assert all(abs(taken[s] - x) <= max(size(t) for _, t, of in rows[3] if of == s) for s, x in targets_by_hand(dict(sizes)).items())
    # Ids that spell the text, of the best score.
    v = sentencepiece.Vocabulary.load(sentencepiece.MODEL)
    encoded = kept[5].collect()
    spelled = sentencepiece.decode_ids(v, np.concatenate([np.array(r.token_ids, dtype=np.int64) for r in encoded]), np.array([r.n_tokens for r in encoded]))
    assert Counter((r.doc_id, t) for r, t in zip(encoded, spelled)) == Counter((i, t) for i, t, _ in rows[4])
    assert all(abs(score_of(v, r.token_ids) - best_by_hand(v, t)) < 1e-6 for r, t in list(zip(encoded, spelled))[:25])


def test_stages_on_an_empty_table(spark, sf_dir, made):
    docs = made.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
