import datetime
import random
import uuid

from pyspark.sql import functions as F

from parcelforge.enums import OPEN_STATUSES, ROLES, SLA_HOURS, STATUSES, TERMINAL_STATUSES
from parcelforge.streaming import audit, review

START = datetime.datetime(2024, 1, 1)
SCHEMA = "parcel_id long, id long, at timestamp, target string, actor string, role string, priority string"


def requests(n=400, seed=1):
    r = random.Random(seed)
    ats = sorted(r.randrange(0, 20 * 86_400) for _ in range(n))
    return [(r.randrange(0, 25), k, START + datetime.timedelta(seconds=at), r.choice(STATUSES), f"u{k % 3}", r.choice(ROLES), r.choice(list(SLA_HOURS))) for k, at in enumerate(ats)]


def sequential(rows, until):
    """Each record's requests one after the other, with its deadline between them."""
    out = []
    for p in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == p and x[2] <= until), key=lambda x: (x[2], x[1]))
        status, had, due, told = "pending", None, None, False

        def deadline(to, p=p):
            nonlocal told
            if due is not None and due <= to and not told:
                told = True
                if status in OPEN_STATUSES:
                    out.append((p, None, due, "breach", status, None, None, status))

        for _, number, at, target, actor, role, priority in own:
            due = due or at + datetime.timedelta(hours=SLA_HOURS[priority])
            deadline(at - datetime.timedelta(milliseconds=1))
            why = review.refusal(status, target, role)
            was, status = status, status if why else target
            out.append((p, number, at, "request", was, target, why, status))
        deadline(until)
    return sorted(out, key=repr)


def run(spark, folder, checkpoint, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = review.reviewed(stream, "3600.5 seconds")
    q = out.writeStream.format("parquet").option("path", f"{checkpoint}-{name}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{checkpoint}-{name}")


def rows_of(df):
    return sorted(((r.parcel_id, r.id, r.at, r.kind, r.was, r.target, r.reason, r.review_status) for r in df.collect()), key=repr)


def test_refusals():
    assert review.refusal("pending", "pending", "admin") == "already there" and review.refusal("approved", "rejected", "admin") == "not allowed"
    assert review.refusal("approved", "in_review", "operator") == "needs a reviewer" and review.refusal("approved", "in_review", "reviewer") is None
    assert review.refusal("rejected", "in_review", None) == "needs a reviewer" and set(TERMINAL_STATUSES) == {"approved", "rejected"}


def test_requests_in_event_order_deadlines_and_restart(spark, tmp_path):
    """Requests arrive in three parts, some of them up to an hour late; the last part comes after a restart."""
    rows, r = requests(), random.Random(2)
    arrival = sorted(rows, key=lambda x: x[2] + datetime.timedelta(seconds=r.choice([0, 0, 0, 3500])))
    src, checkpoint = tmp_path / "in", str(tmp_path / "state")
    cuts = [0, 150, 280, len(arrival)]

    def add(k):
        spark.createDataFrame(arrival[cuts[k] : cuts[k + 1]], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))

    until = lambda part: max(x[2] for x in part) - datetime.timedelta(seconds=3600.5)
    add(0)
    add(1)
    first = rows_of(run(spark, str(src), checkpoint, "out"))
    assert first == sequential(rows, until(arrival[: cuts[2]]))
    add(2)
    again = rows_of(run(spark, str(src), checkpoint, "out"))
    assert again == sequential(rows, until(arrival)) and len(again) > len(first) > 0
    assert {x[3] for x in again} == {"request", "breach"} and {x[6] for x in again} >= {None, "not allowed", "already there"}


def test_dedup_over_micro_batches(spark, tmp_path):
    """Repeats within a batch, in later batches, and late ones; what comes after the watermark has passed is new again."""
    at = lambda h: START + datetime.timedelta(hours=h)
    parts = [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(3)), ("c", at(20)), ("b", at(1))], [("c", at(21)), ("d", at(90))], [("f", at(91)), ("d", at(92))], [("a", at(94)), ("e", at(2))]]
    src = str(tmp_path / "docs")
    for k, part in enumerate(parts):
        spark.createDataFrame([(s, t, k) for s, t in part], "sha256 string, ingested_at timestamp, part int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("sha256 string, ingested_at timestamp, part int").option("maxFilesPerTrigger", 1).parquet(src)
    name = f"dedup_{uuid.uuid4().hex}"
    q = audit.first_of_content(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(name).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("part")).alias("parts")).collect()
    found = {x.sha256: list(x.parts) for x in got}
    assert found["b"] == [0] and found["c"] == [1] and found["d"] == [2] and found["a"] == [0, 4] and found["f"] == [3]
    assert "e" not in found  # 88 hours behind


def test_documents_in_a_folder_stream_as_those_of_one_file(spark, tmp_path):
    from parcelforge.plans import mapping

    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", None), (5, "b", "")], "doc_id long, text string, source string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.source: r.n for r in mapping.st5(spark, str(tmp_path)).collect()} == {"x": 2, None: 1, "": 1}
