import pytest

from lakesift.operators import synth
from lakesift.schemas import PLAN


@pytest.mark.parametrize("repeatable", [True, False])
def test_equal_utterances_are_spoken_once(spark, repeatable):
    """Once for each voice and text if a backend repeats itself, else once for each utterance; the manifest is the same."""
    said = spark.sparkContext.accumulator(0)

    def backend(voice, text):
        said.add(1)
        return synth.tone_backend(voice, text)

    texts = ["one two three", "four five six seven"] * 20
    plan = spark.createDataFrame([(k, "male", "american", "unknown", v, 40, texts, 0.1) for k, v in enumerate(("en-US-GuyNeural", "en-GB-RyanNeural"))], PLAN)
    rows = synth.generate(plan, backend=backend, gate=None, repeatable=repeatable).orderBy("id").collect()
    assert said.value == (4 if repeatable else 80) and len(rows) == 80
    assert sorted(int(r.id[-6:]) for r in rows) == list(range(80)) and [r.sentence for r in sorted(rows, key=lambda r: r.id[-6:])] == texts * 2
