"""Written intermediates can be removed once they are of no more use."""

from pathlib import Path

from sensorloom.session import discard, materialise


def test_discard_removes_what_was_written(spark):
    kept, gone = (materialise(spark.range(5), name) for name in ("kept", "gone"))
    after = materialise(gone.join(kept, "id"), "after")
    discard(gone)
    folder = lambda df: Path(df.written_to.removeprefix("file:"))
    assert not folder(gone).exists() and folder(kept).exists() and after.count() == 5
    discard(kept, after)
    assert not folder(after).exists()
