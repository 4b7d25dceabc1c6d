import os
import uuid

from pyspark.sql import functions as F

from vellum.operators.ask import ask, kept


def model(log, broken=True):
    """Answers in capitals, fails for 'bad' prompts, and leaves a file for each prompt that it is asked; pickled by value."""
    log = str(log)

    class Model:
        def batch(self, prompts):
            for p in prompts:
                open(os.path.join(log, uuid.uuid4().hex), "w").write(p)
            if broken and any(p.startswith("bad") for p in prompts):
                raise TimeoutError("too slow")
            return [p.upper() for p in prompts]

    return Model()


def test_each_prompt_is_asked_once(spark, tmp_path):
    rows = [(i, f"prompt {i % 10}") for i in range(50)] + [(90, "bad one"), (91, None)]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(3)
    (tmp_path / "log").mkdir()
    asks, path = model(tmp_path / "log"), str(tmp_path / "answers")
    first = {r.id: r for r in ask(df, asks, path, batch=4).collect()}
    assert len(first) == 52 and all(first[i].response == f"PROMPT {i % 10}" for i in range(50))
    assert (first[90].response, first[90].error, first[91].response, first[91].error) == (None, "TimeoutError: too slow", None, None)
    told = len(os.listdir(tmp_path / "log"))
    ask(df.where("id < 50"), asks, path).collect()
    assert len(os.listdir(tmp_path / "log")) == told  # nothing is asked again
    again = ask(df, model(tmp_path / "log", broken=False), path)
    assert again.where("error IS NOT NULL").count() == 0 and len(os.listdir(tmp_path / "log")) == told + 1
    assert again.where("id = 90").first().response == "BAD ONE" and kept(spark, path).count() == 11


def test_plain_callables_and_no_prompts(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "prompt string")
    assert {r.prompt: r.response for r in ask(df, lambda p: p * 2, str(tmp_path / "a")).collect()} == {"x": "xx", "y": "yy"}
    assert ask(df.limit(0), lambda p: p, str(tmp_path / "b")).select(F.col("response"), F.col("error")).count() == 0
