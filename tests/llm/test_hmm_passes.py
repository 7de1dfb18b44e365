import numpy as np

from voxfabric.llm import hmm


def test_default_is_four_passes(spark):
    rows = [(" ".join(["a b c d a c", "d b x y", "c c a q"][i % 3].split()[i % 2 :]),) for i in range(60)]
    docs = spark.createDataFrame(rows, "text string")
    counts = hmm.count_words(docs)
    model, three, four = hmm.train(docs, counts), hmm.train(docs, counts, passes=3), hmm.train(docs, counts, passes=4)
    assert np.allclose(model.emit, four.emit, rtol=1e-9) and np.allclose(model.move, four.move, rtol=1e-9)
    assert not np.allclose(model.move, three.move, rtol=1e-6)
