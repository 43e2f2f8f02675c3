import numpy as np

from rarefold.llm import langid


def test_profiles_equal_plain_bundles():
    letters = langid.letter_vectors()
    text = "Ab, cdé\n\n x"
    slot = [int(langid.SLOT_OF[ord(c)]) for c in " ab cdé x "]
    want = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(slot, slot[1:], slot[2:]):
        if b:
            want += np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c]
    got = np.zeros(langid.DIMENSIONS)
    for part, codes, cells in langid._counts([text], np.array([0]), 1):
        got[:] += (cells @ langid.run_vectors(codes, letters))[0]
    assert np.array_equal(got, want)


def test_long_text_in_parts_counts_every_run(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_CHARS", 7)
    text = "the quick brown fox jumps over it all"
    n = sum(int(cells.sum()) for _, _, cells in langid._counts([text], np.array([0]), 1))
    parts = np.concatenate(langid._part_runs(text))
    assert n == len(parts) and np.array_equal(np.sort(parts), np.sort(langid.letter_runs(text)))


def test_held_out_accuracy_and_awkward_rows(docs, no_docs):
    rows = langid.languages(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for k in (6, 7, 8, 9):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    late = [r for r in rows if r.doc_id and r.doc_id >= 20]
    assert sum(r.lang_pred == truth[r.doc_id] for r in late) >= 0.95 * len(late)
    assert by[13].lang_pred in ("xx", "yy")
    assert langid.languages(no_docs).count() == 0


def test_nothing_learned(docs):
    rows = langid.identify(docs.select("doc_id", "text"), {}).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
