"""The frontier stream: chunks settle once, late rows are told apart, a restart changes nothing."""

import random

from locus.streaming import frontier

SIZE = 10


def arrive(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "reference string, position long, span int").coalesce(1).write.json(f"{folder}/b{k}")


def run(spark, folder, target, checkpoint):
    rows = spark.readStream.schema("reference string, position long, span int").option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    frontier.start(rows, SIZE, target, checkpoint).awaitTermination(120)
    return sorted(map(tuple, frontier.told(spark, target).select("kind", "reference", "chunk_start", "reads", "bases").collect()), key=str)


def expected(batches):
    """Told, and left open, by plain Python."""
    place, counts, told = {}, {}, []
    for rows in batches:
        before, late = dict(place), {}
        for reference, position, span in rows:
            if reference is None or position is None:
                late[("unplaced", reference, None)] = [a + b for a, b in zip(late.get(("unplaced", reference, None), [0, 0]), [1, span], strict=True)]
                continue
            start = position // SIZE * SIZE
            where = late if reference in before and start + SIZE <= before[reference] else counts
            key = ("late", reference, start) if where is late else (reference, start)
            where[key] = [a + b for a, b in zip(where.get(key, [0, 0]), [1, span], strict=True)]
            place[reference] = max(place.get(reference, -(10**9)), position - 2 * SIZE)
        told += [(*k, *v) for k, v in late.items()]
        for reference, start in sorted(counts):
            if start + SIZE <= place[reference]:
                told.append(("settled", reference, start, *counts.pop((reference, start))))
    return sorted(told, key=str), sorted((*k, *v) for k, v in counts.items())


def test_stream_restart_and_state(spark, tmp_path):
    rng = random.Random(1)
    rows = [("a" if k % 3 else "b", 2 * k + rng.randint(-15, 15) if k > 10 else k, rng.randint(1, 5)) for k in range(300)]
    batches = [rows[k : k + 75] for k in range(0, 300, 75)]
    batches[2] = batches[2] + [("a", 3, 1), ("a", 3, 2), ("b", 300, 1), (None, 5, 1), ("a", None, 4)]
    batches[3] = batches[3] + [("c", 1, 1)]
    folder, target, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    arrive(spark, folder, batches[:2])
    assert run(spark, folder, target, checkpoint) == expected(batches[:2])[0]
    for k in (2, 3):
        spark.createDataFrame(batches[k], "reference string, position long, span int").coalesce(1).write.json(f"{folder}/b{k}")
    told, left = expected(batches)
    got = run(spark, folder, target, checkpoint)
    assert got == told and {k for k, *_ in told} == {"settled", "late", "unplaced"}
    assert run(spark, folder, target, checkpoint) == told  # nothing new: nothing is told twice
    assert sorted(map(tuple, frontier.open_chunks(spark, checkpoint).collect())) == left
    assert {r.reference: r.frontier for r in frontier.frontiers(spark, checkpoint).collect()} == {n: max(p for ref, p, _ in sum(batches, []) if ref == n and p is not None) for n in "abc"}
    assert len({x[:3] for x in got if x[0] == "settled"}) == len([x for x in got if x[0] == "settled"])
