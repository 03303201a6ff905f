import itertools
from collections import defaultdict
from pathlib import Path

import corpus_pipeline as pipeline
from lenscube.llm import common, decontamination, quality, secrets, simhash, warc
from lenscube.llm.common import load

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_decisions(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    good = {r.doc_id for r in quality.classify(docs, load(spark, SF, "labels")).collect() if r.predicted}
    after = pipeline.quality_stage(spark, docs, SF)
    assert after.columns == columns and {r.doc_id for r in after.select("doc_id").collect()} == good
    prints = {r.doc_id: [simhash.majority(simhash._mixed(h, k) if k else h) for k in range(4)] for r in after.collect() for h in [simhash.hashes(r.text)]}
    sets = {r.doc_id: set(simhash.hashes(r.text, 5).tolist()) for r in after.collect()}

    def grouped(linked):
        group = {d: d for d in prints}
        changed = True
        while changed:
            changed = False
            for a, b in itertools.combinations(sorted(prints), 2):
                if group[a] != group[b] and linked(a, b):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
        return group

    candidates = grouped(lambda a, b: any((x ^ y).bit_count() <= 5 for x, y in zip(prints[a], prints[b])))
    group = grouped(lambda a, b: candidates[a] == candidates[b] and (prints[a] == prints[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
    groups = {d for d in group if group[d] == d}
    first = pipeline.near_duplicate_stage(spark, after, SF)
    assert first.columns == columns and sorted(r.doc_id for r in first.select("doc_id").collect()) == sorted(groups)
    hit = {r.doc_id: r.contaminated for r in decontamination.report(decontamination.search(decontamination.index(first), load(spark, SF, "benchmark"))).collect()}
    clean = pipeline.decontamination_stage(spark, first, SF)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, h in hit.items() if not h}
    spans = {r.doc_id: r.spans for r in secrets.scan(clean).collect()}
    hidden = pipeline.secrets_stage(spark, clean, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert hidden.columns == columns
    for r in hidden.collect():
        out, at = [], 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += [texts[r.doc_id][at : s.start], "[secret]"]
            at = max(at, s.end)
        assert r.text == "".join([*out, texts[r.doc_id][at:]]) and r.n_chars == len(r.text)


def test_run_packs_what_the_stages_keep(spark):
    sequences, pieces = defaultdict(int), defaultdict(int)
    for r in pipeline.run(spark, SF).collect():
        sequences[r.sequence_id] += r.length
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sequences.values())
    assert pieces and all(total == n for (_, total), n in pieces.items())


def test_stages_with_nulls_repeats_and_any_columns(spark):
    rows = [(1, "plain words of a plain text, all of them good.", "en", "s", 46, "x"), (1, None, None, None, None, None), (None, "", None, None, 0, None), (None, "", None, None, 0, None)]
    rows += [(5, "long " * 60_000, "en", "s", 300_000, "y"), (6, "pass token=abcdefgh " * 3, "en", "s", 60, "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string")
    for table in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == docs.columns
        pieces = pipeline.STAGES[-1][1](spark, table, SF)
        assert (pieces.count() > 0) == (table.count() > 0)


def test_the_shared_folder_is_empty_after_use(spark):
    common.release(spark)
    pipeline.run(spark, SF).collect()
    warc.round_trip(load(spark, SF, "pages")).collect()
    folder = Path(common.checkpoint_dir(spark).removeprefix("file:"))
    assert len(list(folder.glob("pipeline-*"))) == 1
    common.release(spark)
    assert not [p for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")]
