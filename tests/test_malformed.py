from marketlens.sources import staging


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_rows_of_another_width_are_counted_and_kept(spark, tmp_path):
    text = 'order_id,review_score,note\n1,5,"a, ""b"""\n2,4\n\n3,3,x,"y,z"\n4\n5,1,"two\nlines"\n'
    paths = {"reviews": write(tmp_path, "reviews.csv", text)}
    row = staging.malformed_counts(spark, paths).first()
    assert tuple(row) == ("reviews", 2, 2, 1, 0)
    bad = {r._corrupt_record: (r.n_fields, r.expected_fields) for r in staging.malformed_rows(spark, "reviews", paths["reviews"]).collect()}
    assert {k.strip(): v for k, v in bad.items()} == {"2,4": (2, 3), '3,3,x,"y,z"': (4, 3), "4": (1, 3)}


def test_whole_files_have_no_malformed_rows(spark, tmp_path):
    paths = {"products": write(tmp_path, "products.csv", "product_id,product_category_name\n1,a\n2,\n")}
    assert tuple(staging.malformed_counts(spark, paths).first()) == ("products", 2, 0, 0, 0)


def test_files_that_one_task_would_read_are_named_beforehand(spark, tmp_path):
    paths = {
        "reviews": write(tmp_path, "reviews.csv", "order_id,review_score\n" + "1,5\n" * 50),
        "products": write(tmp_path, "products.csv", "product_id,product_category_name\n" + "1,a\n" * 90),
        "payments": str(tmp_path / "payments.csv"),
    }
    rows = spark.range(300).selectExpr("cast(id as string) order_id", "'x' payment_type")
    rows.coalesce(1).write.option("header", True).option("compression", "gzip").csv(paths["payments"])
    listed = {r.source: (r.n_bytes, r.is_split) for r in staging.source_files(spark, paths).collect()}
    assert listed["reviews"] == (222, False) and listed["products"] == (393, True)
    assert listed["payments"][0] > 0 and not listed["payments"][1]
    assert [r.source for r in staging.whole_files(spark, paths, over_bytes=200).collect() if r.source != "payments"] == ["reviews"]
    assert staging.whole_files(spark, paths).isEmpty()
    assert staging.whole_files(spark, {"reviews": paths["reviews"]}, 0, multiline=()).isEmpty()
    # Sizes come from the listing: no content is asked for
    plan = staging.source_files(spark, paths)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
