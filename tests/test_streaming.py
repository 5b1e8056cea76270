from tidemark.streaming import accumulate

SF = "/root/testdata/sf0.001"


def test_a_folder_of_part_files_gives_the_same_windows_as_a_file(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda folder: sorted((r["event_type"], r["start"], round(r["mm"], 4), r["n"]) for r in accumulate.run_once(spark, folder, "6 hours", "6 hours").collect())
    one, many = rows(SF), rows(str(tmp_path))
    assert one and one == many and sum(r[3] for r in many) == events.dropDuplicates(["event_id", "ts"]).count()
