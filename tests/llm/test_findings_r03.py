"""Small cases of the third round's findings about the training-data operators."""


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    """More documents than any sample took: each candidate is counted, and equal ones are one weighted row."""
    from pyspark.sql import functions as F

    from parafid.llm import pii
    n = 30_000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "call +49 30 1234567").otherwise(
        "server 10.0.0.300 is down").alias("text"))
    seen = []
    plain = pii.Store.keep

    def keep(self, df):
        out = plain(self, df)
        seen.append(out)
        return out
    monkeypatch.setattr(pii.Store, "keep", keep)
    model = pii.train(d)
    rows = seen[0].agg(F.sum("n").alias("all"), F.count("*").alias("rows"), F.sum(F.col("n") * (1 - F.col("label"))).alias("no")).first()
    assert model is not None and rows["all"] >= n and rows.rows < 20 and rows.no >= n / 2


def test_near_dedup_builds_the_simhash_index(spark, monkeypatch):
    """Fingerprints choose the first pairs, and pairs they miss or wrongly link are settled by exact similarity."""
    from parafid.llm import overlap, simhash
    seen = []
    plain = simhash.near_links

    def links(prints, *a, **k):
        seen.append(sorted(r.print for r in prints.collect()))
        return plain(prints, *a, **k)
    monkeypatch.setattr(overlap, "near_links", links)
    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, long + " more", " ".join(f"v{i}" for i in range(60)), None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in overlap.without_copies(d).collect())
    assert kept == [0, 2, 3]
    as_long = [p - (1 << 64) if p >= 1 << 63 else p for p in {simhash.fingerprint(t) for t in texts}]
    assert seen == [sorted(as_long)]
