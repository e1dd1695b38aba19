import re
from collections import Counter

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory, texts):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([r[:5] for r in rows] + [(900, "password=abcdef12345 " + texts[20], "en", "src0", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(texts[-1].split(" ")[40 * k : 40 * k + 30])) for k in range(3)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline as p

    assert [k for k, _ in p.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns, name
        seen.append(docs.count())
    assert seen[0] == seen[1] > seen[2] > seen[3] == seen[4]  # no label is toxic
    texts = [r.text for r in docs.collect()]
    assert not any("password=" in (x or "") for x in texts) and max(Counter(texts).values()) == 1
    out = p.run(spark, folder).collect()
    assert len(out) == seen[-1] and all(r.n_tokens == len(r.ids) for r in out)


def test_empty_tables(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_equal_brute_force(spark, folder):
    """Each stage, on all that its predecessor kept, against its rule written out."""
    import corpus_pipeline as p
    from graphloom.llm.bpe import default_vocabulary, tokenizer
    from graphloom.llm.secrets import default_vocabulary as pieces
    from graphloom.llm.secrets import find_spans
    from graphloom.llm.toxicity import LIMIT, fit_toxicity, toxicity

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = Counter((r.doc_id, r.toxic) for r in toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect())
    assert model.thresholds[0] > 0 and 0 < LIMIT < 1
    kept = p.drop_toxic(spark, docs, folder)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, bad), n in scores.items() if not bad})

    before = kept.collect()
    sets = [grams(r.text) for r in before]
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b) if a or b else True
    group = list(range(len(before)))
    changed = True
    while changed:
        changed = False
        for i in range(len(before)):
            for j in range(len(before)):
                if group[j] < group[i] and like(sets[i], sets[j]):
                    group[i], changed = group[j], True
    best = {}
    for k, r in enumerate(before):
        best.setdefault(group[k], []).append((r.doc_id is None, r.doc_id or 0))
    kept = p.drop_near_duplicates(spark, kept, folder)
    after = kept.collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in after) == Counter(min(x) for x in best.values())
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    items = [grams(r.text.lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r for r in after if not any(len(q & grams((r.text or "").lower())) >= 0.8 * len(q) for q in items)]
    kept = p.drop_contaminated(spark, kept, folder)
    assert rows_of(kept) == Counter(map(tuple, clean)) and len(clean) < len(after)

    def masked(text):
        if text is None:
            return None
        gone = [None] * len(text)
        for a, _, b, _ in find_spans(text, pieces()):
            gone[a:b] = [True] * (b - a)
        spans = sorted((a, b) for a, _, b, _ in find_spans(text, pieces()))
        starts = {a for k, (a, _) in enumerate(spans) if all(b <= a for _, b in spans[:k])}
        return "".join("[SECRET]" * (k in starts) if x else c for k, (c, x) in enumerate(zip(text, gone, strict=True)))

    wanted = Counter((r.doc_id, masked(r.text), r.lang, r.source, len(masked(r.text)) if masked(r.text) != r.text else r.n_chars) for r in clean)
    kept = p.redact_secrets(spark, kept, folder)
    assert rows_of(kept) == wanted

    t = tokenizer(default_vocabulary())
    got = p.encode(spark, kept, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for (i, x, *_), n in wanted.items() for _ in range(n))


@pytest.mark.parametrize("operator", ["bpe", "quality", "secrets", "suffix_dedup", "recompression", "ngram_join", "lm", "sharding", "decontamination", "toxicity"])
def test_texts_above_every_cutting_size(spark, monkeypatch, operator):
    """Texts that are cut, or stand alone, give what they give when nothing is cut."""
    import random

    from graphloom.llm import bpe, common, decontamination, lm, ngram_join, quality, recompression, repeats, secrets, sharding, suffix_dedup, toxicity, worddict

    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(9000)]
    texts = [" ".join(words), " ".join(words[:4000] + ["new"] + words[4001:]), " ".join(words[100:160]), "short text", "", None, " ".join(words[5000:8000]), "token=abcdef0123456 " * 50]
    docs = spark.createDataFrame([(k, x, "h") for k, x in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(words[2000:2040])), (2, " ".join(words[7000:7400])), (3, "short text")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, 1), (7, 0)], "doc_id long, toxic int")
    run = {
        "bpe": lambda: bpe.encode_documents(docs), "quality": lambda: quality.quality_rules(docs), "secrets": lambda: secrets.scan_secrets(docs), "suffix_dedup": lambda: suffix_dedup.remove_repeats(docs),
        "recompression": lambda: recompression.remove_repeated_words(docs), "ngram_join": lambda: ngram_join.near_duplicates(docs), "lm": lambda: lm.score_documents(docs).drop("score"),
        "sharding": lambda: sharding.shard_rows(docs, 8), "decontamination": lambda: decontamination.contamination(docs, items), "toxicity": lambda: toxicity.toxicity(docs, labels),
    }[operator]
    whole = sorted(repr(r) for r in run().collect())
    for module in (common, bpe, decontamination, lm, ngram_join, quality, secrets, toxicity, repeats):
        if hasattr(module, "slices"):
            monkeypatch.setattr(module, "slices", lambda batch, text="text", limit=0, cut=common.slices: cut(batch, text, 5000))
    monkeypatch.setattr(worddict, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(worddict, "chunks", lambda batches, limit=0, cut=worddict.chunks: cut(batches, 5000))
    monkeypatch.setattr(worddict, "RUN_WORDS", 1000)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 2000)
    assert sorted(repr(r) for r in run().collect()) == whole
