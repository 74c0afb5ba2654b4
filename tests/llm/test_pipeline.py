"""The pipeline's stages, each on its own input."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    """Words in fives, or all of them where they are fewer."""
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(place)))
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        assert docs.columns == columns or place == len(corpus_pipeline.STAGES) - 1
    good, distinct, apart, mixed, encoded = kept
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    chosen = {r.doc_id for r in good}
    clean = [i for i, q in marks.items() if q == 1]
    assert sum(i in chosen for i in clean) >= 0.95 * len(clean) and sum(marks.get(i) == 0 for i in chosen) <= 0.2 * sum(q == 0 for q in marks.values())
    last = {}
    for r in good:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in distinct) == sorted(last.values())
    sets = [shingles(r.text) for r in distinct]
    ids, up = [r.doc_id for r in distinct], list(range(len(distinct)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    assert sorted(r.doc_id for r in apart) == sorted(map(min, least.values()))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in apart} and max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    assert len(encoded) == len(mixed) and all(r.n_tokens == len(r.ids) > 0 for r in encoded if r.text)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid string, name string, size int, kept string, taken string, component_id string, root string"


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_and_empty_tables(spark, tmp_path, place):
    """Nulls in any column, repeated rows, empty and very long texts, clashing names, and no rows at all."""
    stage = corpus_pipeline.STAGES[place][1]
    long = "a quiet river walks under bright fields in the morning. " * 90_000
    texts = [None, "", " ", "one", "one", "one two three four five six", long, long + "x", "the end of the text is here and now"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "web", None, "r", None, 1, "k", "t", "c", "z") for i, t in enumerate(texts)]
    rows += [(None, "without an id", *rows[0][2:]), (None, None, *rows[0][2:]), rows[3], rows[3]]
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, COLUMNS)
    found = stage(spark, docs, str(tmp_path))
    names = docs.columns
    last = place == len(corpus_pipeline.STAGES) - 1
    assert found.columns[: len(names)] == names and (last or found.columns == names)
    out = found.collect()
    assert all((r.rid, r.size, r.kept) == ("r", 1, "k") for r in out) and {r.doc_id for r in out} <= {r[0] for r in rows}
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out)
    expected = {
        "quality_classifier": sorted(-1 if r[0] is None else r[0] for r in rows),  # all labels are good
        "exact_dedup": [-1, 1, 2, 4, 5, 6, 7, 8],  # of equal texts the largest doc_id; null counts as empty
        "near_dup": [-1, -1, 0, 1, 2, 3, 3, 3, 5, 6, 8],
        "sentencepiece": sorted(-1 if r[0] is None else r[0] for r in rows),
    }.get(corpus_pipeline.STAGES[place][0])
    assert expected is None or ids == expected
    empty = spark.createDataFrame([], COLUMNS)
    assert stage(spark, empty, str(tmp_path)).count() == 0
