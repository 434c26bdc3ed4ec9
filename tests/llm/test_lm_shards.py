import numpy as np

from kumiki.llm import lm_score as M


def test_coded_shards_train_what_texts_train(spark):
    r = np.random.RandomState(5)
    names = np.array([f"w{k}" for k in range(3000)])
    rows = [(k, " ".join(names[(r.rand(r.randint(0, 90)) ** 2 * 3000).astype(int)])) for k in range(400)] + [(900, ""), (901, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = M.Vocabulary(M.cell_counts(docs))
    held = spark.sparkContext.broadcast(words)
    shards = M.sharded(docs, held)
    assert shards.columns == ["shard", "ids"]
    assert sorted(len(x.ids) for x in shards.collect()) == sorted(2 * len(t.split()) for _, t in rows)
    assert M.train(shards, words).pack() == M.train(M.sharded(docs), words).pack()


def test_contexts_stay_in_their_texts():
    ids, first = np.array([5, 6, 7, 8, 9]), np.array([0, 1, 1, 5])
    got = M._contexts(ids, first, np.array([0, 1, 3]), 99)
    assert got.tolist() == [[99, 99, 99, 99], [99, 99, 7, 8], [6, 7, 9, 99]]
