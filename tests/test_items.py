import json
import random
from datetime import datetime, timedelta

import pytest

from quillmill.streaming import items

T0 = datetime(2024, 1, 1)


def event(run, position, kind, attempt=None, ok=None, excluded=None, payload=None, at=0):
    return {"run_id": run, "position": position, "item_id": f"i{position}", "kind": kind, "attempt": attempt, "ok": ok, "excluded": excluded, "payload": payload, "at": (T0 + timedelta(seconds=at)).isoformat()}


def brute(events, attempts):
    """States by the rules, from all events at once; results in order up to the first item that isn't final."""
    own = {}
    for e in events:
        if e["run_id"] is not None and e["position"] >= 1:
            own.setdefault((e["run_id"], e["position"]), []).append(e)
    states = {}
    for key, all_ in own.items():
        planned = [e for e in all_ if e["kind"] == "planned"]
        if any(e["excluded"] for e in planned):
            states[key] = ("skipped", None)
            continue
        for a in range(1, attempts + 2):
            mine = [e for e in all_ if e["attempt"] == a]
            if a > attempts:
                states[key] = ("quarantined" if planned else "in_progress", None)
            elif good := [e["payload"] for e in mine if e["kind"] == "result" and e["ok"]]:
                states[key] = ("succeeded", min(good)) if planned else ("in_progress", None)
            elif any(e["kind"] == "result" for e in mine):
                continue
            else:
                states[key] = ("in_progress" if any(e["kind"] == "started" for e in mine) else "pending", None)
            break
    out = []
    for run in {r for r, _ in states}:
        at = 1
        while states.get((run, at), ("",))[0] in items.FINAL:
            out.append((run, at, *states[run, at]))
            at += 1
    return states, sorted(out)


def written(folder, k, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{k:03}.json").write_text("\n".join(map(json.dumps, events)))


def run(spark, folder, base, **kw):
    stream = spark.readStream.schema(items.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    query = items.follow(spark, stream, f"{base}/out", f"{base}/checkpoint", **kw)
    query.awaitTermination()
    states = {(r.run_id, r.position): (r.state, r.payload) for r in items.states(spark, f"{base}/out").collect()}
    return states, sorted(tuple(r) for r in items.released(spark, f"{base}/out").select("run_id", "position", "state", "payload").collect())


def many(seed):
    """Two runs of items planned, started and tried up to four times, with missing results, repeats and broken rows."""
    rng, out = random.Random(seed), []
    for name, n in (("a", 23), ("b", 9)):
        for p in range(1, n + 1):
            if rng.random() < 0.9:
                out.append(event(name, p, "planned", excluded=rng.random() < 0.15))
            for a in range(1, rng.randrange(1, 5)):
                if rng.random() < 0.8:
                    out.append(event(name, p, "started", a))
                if rng.random() < 0.95:
                    out.append(event(name, p, "result", a, rng.random() < 0.6, payload=f"{name}{p}.{a}"))
    out += out[::4] + [event(None, 1, "planned"), event("a", 0, "planned"), event("a", 1, "result", 99, True), event("a", 1, "result", None, True), event("a", 2, "noise", 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_repeated_and_missing(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(items, "BLOCK", 5)
    events = many(seed)
    random.Random(seed).shuffle(events)
    for k in range(3):
        written(tmp_path / "in", k, events[k::3])
    assert run(spark, tmp_path / "in", tmp_path, attempts=2) == brute(events, 2)


def test_restart_goes_on(spark, tmp_path, monkeypatch):
    """Stopped and started on one checkpoint after every file, the tables are those of one run; a start without new files adds nothing."""
    monkeypatch.setattr(items, "BLOCK", 4)
    events = many(5)
    for k in range(3):
        written(tmp_path / "in", k, events[k::3])
        got = run(spark, tmp_path / "in", tmp_path)
    assert got == brute(events, 3)
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert run(spark, tmp_path / "in", tmp_path) == got and spark.read.parquet(f"{tmp_path}/out").count() == n


def test_patience(spark, tmp_path):
    """An attempt without a result fails once the events' time has gone on; the items behind it are then released."""
    written(tmp_path / "in", 0, [event("r", 1, "planned"), event("r", 2, "planned"), event("r", 1, "started", 1, at=0), event("r", 2, "result", 1, True, payload="two", at=5)])
    states, out = run(spark, tmp_path / "in", tmp_path, attempts=1, patience_seconds=60, lateness="0 seconds")
    assert states["r", 1][0] == "in_progress" and out == []
    written(tmp_path / "in", 1, [event("other", 1, "planned", at=600), event("other", 1, "started", 1, at=600)])
    written(tmp_path / "in", 2, [event("other", 1, "result", 1, True, payload="x", at=601)])
    states, out = run(spark, tmp_path / "in", tmp_path, attempts=1, patience_seconds=60, lateness="0 seconds")
    assert states["r", 1][0] == "quarantined" and out == [("other", 1, "succeeded", "x"), ("r", 1, "quarantined", None), ("r", 2, "succeeded", "two")]


def test_bounds(spark):
    with pytest.raises(ValueError, match="attempts"):
        items.follow(spark, spark.createDataFrame([], items.EVENTS), "x", "y", attempts=0)
    of = lambda *x: items.state_of(True, False, *x, 3)
    assert of(0b1, 0b1, 0b1) == ("succeeded", 1)  # both a failure and a success of one attempt: it succeeded
    assert of(0b10, 0b1, 0) == ("in_progress", 2) and of(0, 0b1, 0) == ("pending", 2) and of(0, 0, 0b10) == ("pending", 1) and of(0, 0b111, 0) == ("quarantined", 3)
    assert items.state_of(False, True, 0, 0, 0b1, 3) == ("in_progress", 1)


class CountedMap(dict):
    """A map state that counts accesses."""

    calls = 0

    def _counted(self, x):
        self.calls += 1
        return x

    def containsKey(self, k):
        return self._counted(k in self)

    def getValue(self, k):
        return self._counted(self[k])

    def updateValue(self, k, v):
        self[k] = self._counted(v)

    def removeKey(self, k):
        del self[self._counted(k)]


class CountedValue:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


class Handle:
    def __init__(self):
        self.map, self.value = CountedMap(), CountedValue()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value


def test_a_block_of_items_takes_few_accesses_to_the_state():
    """Of a block's 1,000 items, all but the first are planned and done, so they wait; then it comes, and they leave."""
    row = lambda p, kind, **kw: items.Row(position=p, item_id=f"i{p}", kind=kind, attempt=kw.get("attempt"), ok=kw.get("ok"), excluded=None, payload=None, at_us=None)
    handle, processor = Handle(), items._Items(3, None, 1_000)
    processor.init(handle)
    waits = [row(p, k, **kw) for p in range(2, 1_001) for k, kw in (("planned", {}), ("result", {"attempt": 1, "ok": True}))]
    assert len(list(processor.handleInputRows(("r", 0), iter(waits), None))) == 999 and sum(len(v[0]) for v in handle.map.values()) == 999
    out = list(processor.handleInputRows(("r", 0), iter([row(1, "planned"), row(1, "result", attempt=1, ok=True)]), None))
    assert [r.position for r in out if r.kind == "release"] == list(range(1, 1_001)) and not handle.map and handle.value.held == (1_001,)
    assert handle.map.calls < 100
