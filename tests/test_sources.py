import random

import pandas as pd
from pyspark.sql import functions as F

from kvizmill.sources import files
from kvizmill.streaming.leitner import leitner_stream, step
from kvizmill.streaming.posts import window_counts
from kvizmill.streaming.runs import drained, stream_table


def test_markdown_blocks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\n### 1. (#345)\nПервый вопрос\nОтвет\n\n### 2. (#346)\nВторой\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("1. Один\n2. Два\n", encoding="utf-8")
    got = sorted((r.path[-4:], r.number, r.id, r.body) for r in files.read_markdown_questions(spark, str(tmp_path)).collect())
    assert got == [("a.md", 1, 345, "Первый вопрос\nОтвет"), ("a.md", 2, 346, "Второй"), ("b.md", 1, None, "Один"), ("b.md", 2, None, "Два")]


def test_survey(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,history,sport\nИван,4,\n,5,5\nПётр,x,2\n", encoding="utf-8")
    got = sorted(map(tuple, files.read_survey(spark, str(tmp_path / "s.csv"), ["history", "sport"]).collect()))
    assert got == [("Иван", "history", 4), ("Иван", "sport", 0), ("Пётр", "history", 0), ("Пётр", "sport", 2)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"username": "a", "title": "А"},\n {"username": "b"}]', encoding="utf-8")
    df = files.read_json_document(spark, str(tmp_path / "d.json"), "username string, title string")
    assert sorted((r.username, r.title) for r in df.collect()) == [("a", "А"), ("b", None)]
    files.write_json_lines(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert [r.username for r in files.unprocessed(df, df.where("username = 'a'"), "username").collect()] == ["b"]


def test_streams_over_several_files(spark, tmp_path):
    """The same state whether the attempts come in one file or in many."""
    rows = [(i, i % 3, i % 2, i, i % 5 != 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, user_id long, question_id long, t int, knew boolean").withColumn("attempted_at", F.timestamp_seconds("t")).drop("t")
    states = []
    for parts in (1, 4):
        folder = f"{tmp_path}/{parts}/attempts.parquet"
        df.repartitionByRange(parts, "id").write.parquet(folder)
        changes = drained(leitner_stream(stream_table(spark, f"{tmp_path}/{parts}", "attempts")), "update")
        last = changes.groupBy("user_id", "question_id").agg(F.max_by(F.struct("box", "streak"), "version").alias("s"))
        states.append(sorted(map(str, last.collect())))
    assert states[0] == states[1] and len(states[0]) == 6


class Kept:
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def test_one_call_folds_all_questions_of_a_user():
    """Each question as by itself, over batches with late and repeated attempts, in frames of a few rows."""
    r, state, plain, sizes = random.Random(5), Kept(), {}, []
    for batch in range(8):
        rows = [(r.randrange(40), 10 * batch + r.randrange(25), r.randrange(3), r.random() < 0.7) for _ in range(60)]
        df = pd.DataFrame(rows, columns=["question_id", "at", "id", "knew"]).drop_duplicates(["question_id", "at", "id"])
        df = pd.concat([df, df.iloc[:5]])
        got = pd.concat(step((7,), iter([df.iloc[:9], df.iloc[9:]]), state))
        for q, at, i, knew in sorted(df.itertuples(index=False)):
            streak, *last = plain.setdefault(q, (0, -1, -1))
            if [at, i] > last:
                plain[q] = (streak + 1 if knew else 0, at, i)
        assert sorted(got.itertuples(index=False, name=None)) == [(7, q, *plain[q]) for q in sorted(set(df["question_id"]))]
        sizes.append(len(state.get[0]))
    assert sizes == sorted(sizes) and sizes[-1] == len(plain)


def test_empty_stream(spark, tmp_path):
    schema = "channel_id long, created_at timestamp, views long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/posts.parquet")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/[p]osts.parquet")
    assert drained(window_counts(stream, "1 day", "1 day"), "update").count() == 0
