import os

import pytest
from rows import values

from quern.plans import registry
from quern.operators.traces import TASK_SECONDS

INPUTS = {
    "WordCount": (["a b a"], ["a\t2", "b\t1"]),
    "SequenceCount": (["a b c"], ["a|b|c|part.txt\t1"]),
    "InvertedIndex": (["a b a"], ["a\tpart.txt", "b\tpart.txt"]),
    "TermVectorPerHost": (["a " * 12 + "b"], ["part.txt\ta:12"]),
    "HistogramRatings": (["1:1_4,2_4,3_5", "x"], ["4\t2", "5\t1"]),
    "HistogramMovies": (["1:1_4,2_4", "2:1_3"], ["3.5\t1", "4.5\t1"]),
    "Classification": (["1:1_4", "2:7_1"], ["0\t2", "1\t1"]),
    "Kmeans": (["1:1_4", "2:7_1"], ["0\t1.0 2 1 7_1", "0\t2:7_1", "1\t1.0 1 1 1_4", "1\t1:1_4"]),
    "SelfJoin": (["p,q,b", "p,q,a"], ["p,q,a\tb"]),
    "AdjList": (["a,b"], ["a\tfrom{}:to{b}", "b\tfrom{a}:to{}"]),
}


def put(folder, name, lines):
    path = os.path.join(folder, name)
    os.mkdir(path)
    with open(os.path.join(path, "part.txt"), "w") as out:
        out.write("".join(line + "\n" for line in lines))
    return path


@pytest.mark.parametrize("name", list(INPUTS))
def test_text_jobs(spark, folder, name):
    lines, expected = INPUTS[name]
    model = put(folder, "model", ["0 0.5 20 1 7_2", "1\t0.5 10 1 1_2"])
    registry.run_job(spark, name, put(folder, "in", lines), folder + "/out", model)
    assert [v for (v,) in values(spark.read.text(folder + "/out"))] == expected
    assert registry.task_seconds(name) == TASK_SECONDS[name]


def test_every_job_is_tried_and_a_model_is_asked_for(spark, folder):
    assert set(INPUTS) == set(registry.JOBS)
    with pytest.raises(ValueError, match="model"):
        registry.run_job(spark, "Kmeans", folder, folder + "/out")


def test_sort_jobs(spark, folder):
    registry.run_generate(spark, 500, folder + "/gen", 3)
    registry.run_sort(spark, folder + "/gen", folder + "/sorted", 4)
    registry.run_validate(spark, folder + "/sorted", folder + "/report")
    assert spark.read.text(folder + "/report").count() == 0
    registry.run_validate(spark, folder + "/gen", folder + "/bad")
    assert spark.read.text(folder + "/bad").count() > 0
    sizes = {os.path.getsize(f"{folder}/sorted/{f}") % 100 for f in os.listdir(folder + "/sorted") if f.startswith("part")}
    assert sizes == {0}
