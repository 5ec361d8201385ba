"""The pipeline's language stage rejects only what has no language."""

import pyarrow as pa

from linkengine.llm import language


def test_evenly_mixed_text_stays(monkeypatch):
    scored = {"plain": ("en", 0.99), "mixed": ("de", 0.34), "none": (language.UNKNOWN, 0.0)}

    def predict(model):
        def run(batches):
            for b in batches:
                rows = [scored[x] for x in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "lang_pred", "score"])

        return run

    monkeypatch.setattr(language, "_predict", predict)
    rows = pa.record_batch([pa.array([1, 2, 3]), pa.array(["plain", "mixed", "none"])], names=["doc_id", "text"])
    kept = pa.Table.from_batches(list(language._known(None, 1)([rows])))
    assert kept["text"].to_pylist() == ["plain", "mixed"]
