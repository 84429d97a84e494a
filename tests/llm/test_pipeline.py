"""The pipeline against sequential versions of its stages, and each stage on odd rows."""

from collections import defaultdict

import pytest
from test_contracts import SCHEMA, TEXTS, base_spans, component_ids, crc, ids_of, leak_rows, re, tokenizer  # noqa: F401

import corpus_pipeline
from foliate.llm.base import DOC_COLUMNS, table

SF = "/root/testdata/sf0.001"


def masked(rows):
    """Texts of (id, text, source) with base spans and tokens of one owner masked."""
    found, owners = [], defaultdict(set)
    for _, t, source in rows:
        base = base_spans(t)
        own = [(m.start(), 3, "owned", m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t or "") if all(re.search(p, m[0]) for p in ("[a-z]", "[A-Z]", "[0-9]"))]
        own = [s for s in own if not any(b[0] < s[3] and s[0] < b[3] for b in base)]
        found.append((base, own))
        for s in own:
            owners[s[4]] |= {source} - {None}
    out = {}
    for (i, t, _), (base, own) in zip(rows, found):
        parts, at = [], 0
        for a, _, _, b, _ in sorted(base + [s for s in own if len(owners[s[4]]) < 2]):
            if a >= at:
                parts += [t[at:a], "[secret]"]
            at = max(at, b)
        out[i] = "".join(parts) + t[at:]
    return out


def test_whole_pipeline(spark, tokenizer):  # noqa: F811
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    kept = [d for d in docs if any(c.isalpha() for c in d[1])]
    kept = [d for d, (i, _, least) in zip(kept, component_ids([d[:2] for d in kept])) if i == least]
    leaks = leak_rows([d[:2] for d in kept], items)
    kept = [d for d in kept if leaks[d[0]][0][2] == 0]
    assert 100 < len(kept) < len(docs) and any(r[0][2] for r in leaks.values())
    texts = masked(kept)
    assert any(texts[i] != t for i, t, _ in kept)
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]] += r["length"]
    assert pieces.keys() == texts.keys() and max(sequences.values()) <= 1024
    for i, own in pieces.items():
        ids, at = ids_of(tokenizer, texts[i]), 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), crc(ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 3}", len(t or ""), 1.0, 2, "x", 3) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, None, None, None, None, None, None, None, None), (None, "words with no id", "en", None, 3, 1.0, 1, "y", 2)]
    name, stage = corpus_pipeline.STAGES[k]
    for df in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        out = stage(spark, df, SF)
        got = out.collect()
        if k < 4:
            assert tuple(out.columns) == DOC_COLUMNS
        if k == 0:
            assert all(any(c.isalpha() for c in r["text"] or "") for r in got)
        if k == 1 and df.count():
            assert len([r for r in got if r["doc_id"] == 4]) == 1
        if k in (2, 3):
            assert len(got) == df.count()
    assert name
