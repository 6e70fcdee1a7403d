import hashlib

import corpus_pipeline
from linkquarry.llm import bpe, decontaminate, secrets, tokens


def test_stages_on_whole_tables(spark, docs, sf):
    from tests.llm.test_nearcopies import brute_kept

    rows = docs.toPandas().sort_values("doc_id", ignore_index=True)
    one = corpus_pipeline.keep_languages(spark, docs, sf)
    assert one.columns == docs.columns and one.count() == len(rows)  # every text here is in a learned language
    two = corpus_pipeline.drop_near_copies(spark, docs, sf)
    kept = rows[rows.doc_id.isin(brute_kept(list(zip(rows.doc_id, rows.text, strict=True))))]
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.select("doc_id").collect()) == kept.doc_id.tolist()
    items = [decontaminate.shingles_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [d for d, t in zip(kept.doc_id, kept.text, strict=True) if not any(s and len(s & decontaminate.shingles_of(t)) >= 0.8 * len(s) - 1e-9 for s in items)]
    got = corpus_pipeline.run(spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.doc_id.tolist() == clean and got.round_trip.all()
    library, text = tokens.load_tokenizer(tokens.default_vocabulary()), rows.set_index("doc_id").text
    for d, n, digest, ids in zip(got.doc_id, got.n_tokens, got.decoded_sha256, got.ids, strict=True):
        t = text[d]
        t = secrets.redact(t, secrets.find_secrets(t)[1])
        assert digest == hashlib.sha256(t.encode()).hexdigest() and library.encode(t, add_special_tokens=False).ids == list(ids) and n == len(ids)
    assert bpe.BORDER_BITS == 11


def test_stages_on_odd_and_no_rows(spark, odd, none, sf):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf)
            assert got.columns == docs.columns and got.count() <= docs.count(), name
        assert corpus_pipeline.encode(spark, docs, sf).count() == docs.count()
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, odd, sf).collect()}
    assert "abc123XYZ_9876" not in redacted[11].text and redacted[11].n_chars == len(redacted[11].text)
    assert corpus_pipeline.drop_near_copies(spark, odd, sf).filter("doc_id = 2").count() == 0
