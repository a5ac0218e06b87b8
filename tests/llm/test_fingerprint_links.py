"""The near-duplicates stage links what fingerprints link, whatever the sets of five-word shingles say."""

import corpus_pipeline
from conftest import SCHEMA
from vecfold.llm import near_copies, simhash


def linked_pairs(wanted: int):
    """Pairs of texts that fingerprints link and shingle sets do not."""
    found = []
    for seed in range(20_000):
        words = [f"w{seed}x{k * k % 97}" for k in range(60)]
        a, b = " ".join(words), " ".join("new" if k in (20, 40) else w for k, w in enumerate(words))
        far = not near_copies.similar(near_copies.shingle_set(a), near_copies.shingle_set(b))
        if far and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= simhash.THRESHOLD:
            found.append((a, b))
            if len(found) == wanted:
                return found
    raise AssertionError("no such pairs")


def test_the_stage_links_by_fingerprint(spark):
    (a, b), (c, d) = linked_pairs(2)
    # the text of b has a near copy by its shingles, so three documents are one group
    longer = b + " tail"
    rows = [(4, a), (2, b), (7, longer), (5, c), (6, d), (8, "apart from all others here"), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect())
    assert kept == [2, 5, 8, 9]
