"""Learning over shards: the rules of one process, whatever is guessed."""

import random
import threading

import pytest

from lexmill.operators import shards, train
from lexmill.runtime import temporary, written

SCHEMA = "pre_token string, freq long"


def words_of(seed, n=150, letters="abcd", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): rng.randrange(1, 30) for _ in range(n)}


def learned(spark, words, merges, counting, known=(), **args):
    with temporary(spark):
        return shards.learn_sharded(spark.createDataFrame(list(words.items()), SCHEMA), merges, 2, counting, known, **args)


@pytest.mark.parametrize("counting", train.COUNTINGS)
def test_as_one_process(spark, counting):
    words = words_of(1)
    want = train.learn([(w.encode(), n) for w, n in words.items()], 40, 2, counting)
    assert learned(spark, words, 40, counting) == want
    # Known rules come in one round, before the others.
    assert learned(spark, words, 40, counting, known=want[:25]) == want
    assert learned(spark, words, 9, counting, known=want[:25]) == want[:9]


@pytest.mark.parametrize("counting", train.COUNTINGS)
def test_bad_guesses_and_few_known_pairs(spark, counting):
    """Guesses from a few words, a bound that is soon reached, ties all over: more rounds, the same rules."""
    words = words_of(2, n=60) | {"é🎈x" * 3: 2, "a" * 40: 3}
    want = train.learn([(w.encode(), n) for w, n in words.items()], 14, 2, counting)
    assert learned(spark, words, 14, counting, shard_words=20, guess_words=5, pairs=6, tried=5) == want


def test_until_nothing_is_left(spark):
    words = {"abab": 3, "b": 9, "ab": 1, "xyz": 1}
    for counting in train.COUNTINGS:
        want = train.learn([(w.encode(), n) for w, n in words.items()], 50, 2, counting)
        assert len(want) < 50 and learned(spark, words, 50, counting) == want
    assert learned(spark, {}, 5, "compat") == [] and learned(spark, {"a": 7}, 5, "compat") == []
    with pytest.raises(ValueError):
        learned(spark, words, 5, "other")


def test_many_merges_a_round(spark, monkeypatch):
    """Where all words are there to guess from, rounds double: far fewer than merges."""
    words = words_of(3, n=400, letters="abcdefgh")
    frames = []
    monkeypatch.setattr(shards, "written", lambda df, name: (frames.append(name), written(df, name))[1])
    got = learned(spark, words, 120, "exact")
    assert got == train.learn([(w.encode(), n) for w, n in words.items()], 120, 2, "exact") and len(frames) < 25


def test_training_is_bounded_by_bytes(spark, monkeypatch):
    """One long word is enough to leave the one process."""
    monkeypatch.setattr(train, "KERNEL_BYTES", 100)
    texts = ["abab abab " + "xy" * 200] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    called = []
    monkeypatch.setattr(shards, "learn_sharded", lambda *a, real=shards.learn_sharded: (called.append(1), real(*a))[1])
    got = train.train(docs, 262).merges
    monkeypatch.setattr(train, "KERNEL_BYTES", 1 << 20)
    assert called == [1] and got == train.train(docs, 262).merges


def test_scopes_belong_to_threads(spark):
    """Two operators at once don't remove each other's frames."""
    at, errors = threading.Barrier(2), []

    def run(k):
        try:
            with temporary(spark) as scope:
                own = written(spark.range(k + 1), "own")
                at.wait(60)
                assert list(scope) == [own._lexmill_path]
                with temporary(spark) as inner:
                    kept = written(spark.range(5), "kept")
                    at.wait(60)
                    inner.keep(kept)
                assert own.count() == k + 1 and kept.count() == 5 and set(scope) == {own._lexmill_path, kept._lexmill_path}
        except BaseException as e:  # noqa: BLE001
            errors.append(e)
            at.abort()

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
