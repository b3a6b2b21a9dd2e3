import pytest

from skein.sources import remote


def _client(rows, throttled=0, log=None):
    """A service over rows that throttles each page `throttled` times; made here, so that workers get it by value."""

    class Service:
        def __init__(self):
            self.times = {}

        def bounds(self):
            return (rows[0][0], rows[-1][0]) if rows else None

        def page(self, after, upto, most):
            n = self.times[after, upto] = self.times.get((after, upto), 0) + 1
            if n <= throttled:
                raise remote.Throttled(0.0)
            found = [r for r in rows if after < r[0] <= upto][:most]
            if log is not None:
                log.add(len(found))
            return found

    return Service()


ROWS = [(k * 3 - 50, f"v{k % 4}") for k in range(200)]


@pytest.mark.parametrize("parts", [1, 7, 1000])
def test_all_rows_once(spark, parts):
    df = remote.remote_table(spark, "t_all", _client(ROWS, 2), "k long, v string", "k", partitions=parts, page=9, wait=0.0)
    assert sorted(map(tuple, df.collect())) == ROWS
    assert remote.remote_table(spark, "t_none", _client([]), "k long, v string", "k").count() == 0


def test_filters_on_the_key_narrow_what_is_asked_for(spark):
    log = spark.sparkContext.accumulator(0)
    df = remote.remote_table(spark, "t_some", _client(ROWS, 0, log), "k long, v string", "k", partitions=3, page=50)
    found = df.filter("k > 10 AND k <= 40 AND v = 'v1'")
    assert sorted(map(tuple, found.collect())) == [r for r in ROWS if 10 < r[0] <= 40 and r[1] == "v1"]
    assert log.value == sum(10 < r[0] <= 40 for r in ROWS)
    assert df.filter("k = 7").count() == 1 and df.filter("k = 8").count() == 0 and df.filter("k > 10 AND k < 5").count() == 0


def test_limit(spark):
    log = spark.sparkContext.accumulator(0)
    df = remote.remote_table(spark, "t_limit", _client(ROWS, 0, log), "k long, v string", "k", partitions=2, page=50, limit=4)
    assert df.limit(4).count() == 4 and log.value <= 8


def test_goes_on_waiting_longer_then_gives_up(spark):
    waits, left = [], [3]

    def call():
        if left[0]:
            left[0] -= 1
            raise remote.Throttled(7.0 if left[0] == 0 else None)
        return "done"

    assert remote.with_backoff(call, 4, 2.0, sleep=waits.append) == "done" and waits == [2.0, 4.0, 7.0]
    left[0] = 9
    with pytest.raises(remote.Unavailable):
        remote.with_backoff(call, 3, 40.0, sleep=waits.append)
    assert waits[3:] == [40.0, 60.0]
    with pytest.raises(KeyError):
        remote.with_backoff(lambda: {}["no"], sleep=waits.append)
    df = remote.remote_table(spark, "t_down", _client(ROWS, 99), "k long, v string", "k", tries=2, wait=0.0)
    with pytest.raises(Exception, match="still throttled after 2 tries"):
        df.collect()
