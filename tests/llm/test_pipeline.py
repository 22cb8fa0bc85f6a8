from __future__ import annotations

import re
import zlib

import corpus_pipeline

from rosterspark.llm import quality, secrets
from tests.llm.test_simhash import groups

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_table(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "secret scans", "best-fit packing"]
    frame, sizes = real, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == real.columns
        sizes.append(frame.count())
    assert sizes[0] < real.count() and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    out = corpus_pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() == sizes[2]


def test_every_row_is_as_by_stages_in_plain_python(spark):
    """The whole pipeline against its stages done by hand on all rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.learn(docs, labels)

    def good(text):
        stats = quality.statistics(text)
        total = rules.base + sum(w for w, tests in rules.weights if all(stats[i] <= b if below else stats[i] > b for i, below, b in tests))
        return 1 / (1 + 2.718281828459045 ** -total) >= 0.3

    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect() if good(r["text"] or ""))
    group, _ = groups([t for _, t in rows])
    rows = [rows[g] for g in sorted(set(group))]
    model = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))

    def clean(text):
        spans = []
        for pattern, g, least in (p[1:] for p in secrets.KINDS):
            spans += [m.span() for m in re.finditer(pattern, text) if len(m[g]) >= least]
        fixed = list(spans)
        for m in re.finditer(r"(?<![^\W_])(?<![+/_.-])[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]={0,2}(?![^\W_])", text):
            bare = m[0].rstrip("=")
            ratio = sum(model.ratios[(ord(a) - 43) * 80 + ord(b) - 43] for a, b in zip(bare, bare[1:])) / (len(bare) - 1)
            if ratio >= model.least and len(set(m[0])) >= 5 and re.search("[A-Za-z]", m[0]) and not any(a <= m.start() and m.end() <= b for a, b in fixed):
                spans.append(m.span())
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in rows:
        ids = [*encoder.encode(clean(text), add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096


def test_empty_tables_and_labels(spark, tmp_path):
    for docs_too in (False, True):
        folder = tmp_path / str(docs_too)
        docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
        (docs.filter("false") if docs_too else docs.filter("doc_id < 40")).write.parquet(f"{folder}/documents.parquet")
        labels.filter("false").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.count() == 0 if docs_too else out.count() > 0
