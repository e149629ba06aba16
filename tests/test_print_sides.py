"""Printed queries read both sides of a hunk."""

from lexdelta.plans import documents


def test_breadcrumbs_of_both_sides(spark, tmp_path):
    h = [(1, "SEC. 1. Old.", "", None, None), (2, "", "SEC. 2. New.", None, None), (3, "SEC. 3. Old.", "SEC. 4. New.", None, None)]
    spark.createDataFrame(h, "hunk_id bigint, v1_text string, v2_text string, v1_anchor string, v2_anchor string").write.parquet(f"{tmp_path}/pdf_hunks.parquet")
    got = {r["doc_id"] for r in documents.print_breadcrumbs(spark, str(tmp_path)).where("kind = 'section'").collect()}
    assert got == {"v1-1", "v2-2", "v1-3", "v2-3"}
