import bz2
import gzip
from datetime import datetime

import pytest

from loomseq.sources import fastq, sinks, tables
from loomseq.streaming import reads as stream

RECORDS = [(f"r{i} runid=ab{i} read={i} ch=7 start_time=2025-01-0{i + 1}T00:00:00Z", "ACGT" * (i + 1), "5" * 4 * (i + 1)) for i in range(4)]


def text(records):
    return "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records)


def test_fastq_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(text(RECORDS[:2])[:-1])  # without the last newline
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text(RECORDS[2:3]))
    with bz2.open(tmp_path / "c.fastq.bz2", "wt") as f:
        f.write(text(RECORDS[3:]))
    got = sorted((r["id"], r["sequence"], r["quality"]) for r in fastq.read_fastq(spark, str(tmp_path)).collect())
    assert got == sorted(RECORDS)
    rows = {r["id"]: r for r in fastq.load_reads(spark, str(tmp_path), header=True).collect()}
    assert rows["r2"]["read_no"] == 2 and rows["r2"]["ch"] == 7 and rows["r2"]["length"] == 12 and rows["r2"]["start_time"] == datetime(2025, 1, 3)


def test_header_defaults(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@only\nAC\n+\n55\n")
    r = fastq.load_reads(spark, str(tmp_path / "x.fq")).first()
    assert (r["id"], r["read_no"], r["ch"], r["start_time"]) == ("only", -1, -1, None)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n\n>two\n>three\nGG-T\n")
    assert sorted((r["id"], r["sequence"]) for r in fastq.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("one x", "ACGTAC"), ("three", "GG-T")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(h, s, q) for h, s, q in RECORDS] + [("null", None, None)], "id string, sequence string, quality string")
    for c in (None, "gz", "bz2"):
        sinks.write_fastq(df, str(tmp_path / f"q{c}"), c)
        assert sorted((r["id"], r["sequence"], r["quality"]) for r in fastq.read_fastq(spark, str(tmp_path / f"q{c}")).collect()) == sorted(RECORDS)
        sinks.write_fasta(df, str(tmp_path / f"f{c}"), c)
        assert sorted((r["id"], r["sequence"]) for r in fastq.read_fasta(spark, str(tmp_path / f"f{c}")).collect()) == sorted((h, s) for h, s, _ in RECORDS)
    sinks.write_csv(df, str(tmp_path / "t.csv"), "gz")
    assert tables.load_file(spark, str(tmp_path / "t.csv")).count() == 5
    sinks.write_table(df, str(tmp_path / "t.parquet"))
    assert tables.load_judged(spark, str(tmp_path / "t.parquet")).first()["id"].count(" ") == 0


def test_primers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("fwd_id,fwd_seq,rev_id,rev_seq\nf,AC GT,r,GGT\nf2,,r2,A\n")
    assert [tuple(r) for r in tables.load_primers(spark, str(tmp_path / "p.csv")).collect()] == [("f", "AC GT", "r", "GGT")]
    (tmp_path / "bad.csv").write_text("fwd_id,fwd_seq\nf,A\n")
    with pytest.raises(ValueError, match="rev_id"):
        tables.load_primers(spark, str(tmp_path / "bad.csv"))


def test_paf(spark, tmp_path):
    fixed = "q1\t100\t5\t95\t+\tt1\t120\t0\t90\t80\t92\t60"
    (tmp_path / "a.paf").write_text(f"{fixed}\ttp:A:P\tNM:i:12\tAS:i:150\tcg:Z:90M\n{fixed}\n\n")
    a, b = sorted(tables.read_paf(spark, str(tmp_path / "a.paf")).collect(), key=lambda r: -r["nm"])
    assert (a["tp"], a["nm"], a["as_score"], a["cigar"], a["s1"], a["q_end"]) == ("P", 12, 150, "90M", 0, 95)
    assert a["similarity"] == pytest.approx(0.88) and a["match_score"] == pytest.approx(80 / 92)
    assert b["nm"] == 0 and b["tp"] is None and b["similarity"] == 1


def test_sam(spark, tmp_path):
    line = lambda q, flag, pos, cigar, *tags: "\t".join([q, str(flag), "t1", str(pos), "60", cigar, "*", "0", "0", "ACGT", "*", *tags])
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n@SQ\tSN:t1\tLN:50\n@PG\tID:x\n" + "\n".join([line("q1", 16, 11, "3S10M2D5M", "NM:i:4", "AS:i:9"), line("q2", 65, 1, "4M", "AS:i:3"), line("q2", 129, 21, "4M", "AS:i:4"), "q3\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*"]) + "\n")
    sam = tables.read_sam(spark, str(tmp_path / "a.sam"))
    r = sam.where("query_id = 'q1'").first()
    assert (r["orientation"], r["t_start"], r["t_end"], r["q_len"], r["t_len"], r["nm"], r["as_score"]) == ("-", 10, 27, 18, 50, 4, 9)
    assert sam.count() == 3
    p = tables.pair_mates(sam).first()
    assert (p["query_id"], p["as_score"], p["cigar"], p["t_start"], p["t_end"]) == ("q2", 7, "4M,4M", 0, 24)


def test_kinds():
    assert [tables.file_kind(x) for x in ("a/b.fq.gz", "x.fasta", "y.csv.bz2", "z.paf")] == ["fastq", "fasta", "csv", "paf"]
    with pytest.raises(ValueError):
        tables.file_kind("my.fastq.backup")


def test_wrapped(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ABCDE", "abcde"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(sinks.wrapped([F.col("a"), F.col("b")], 3)).collect()] == [["ABC", "abc", "DE", "de"], []]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.fastq").write_text(text(RECORDS))
    q = stream.sized(stream.stream_fastq(spark, str(src)), "4-13").writeStream.format("memory").queryName("sized_reads").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {len(r["sequence"]) for r in spark.table("sized_reads").collect()} == {8, 12}
    rows = [("a", datetime(2025, 1, 1, 0, 10), datetime(2025, 1, 1), "AC", "x"), ("a", datetime(2025, 1, 1, 0, 10), datetime(2025, 1, 2), "AC", "x"), ("b", datetime(2025, 1, 1, 0, 50), datetime(2025, 1, 1), "ACG", "x")]
    df = spark.createDataFrame(rows, "id string, start_time timestamp, loaded_at timestamp, sequence string, run_id string")
    df.write.parquet(str(tmp_path / "t"))
    once = stream.first_loads(stream.stream_table(spark, str(tmp_path / "t"), df.schema))
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("once").collect()) == ["a", "b"]
    per = stream.yield_per_window(stream.stream_table(spark, str(tmp_path / "t"), df.schema))
    q = per.writeStream.format("memory").outputMode("complete").queryName("yields").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n_reads"], r["n_bases"]) for r in spark.table("yields").collect()] == [(3, 7)]
