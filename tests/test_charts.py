import xml.etree.ElementTree as et

from lakesift.operators import charts


def test_charts_are_drawings_of_the_tables(spark, tmp_path):
    found = {"n_input": 10, "quality": {"passed": 8, "fail_categories": {"clipped": 1, "low_snr": 2}}, "n_output": 7, "diversity_before": {"gender_distribution": {"male": {"pct": 75.0}, "a<b": {"pct": 25.0}}, "diversity_score": {"overall": 0.5}}, "diversity_after": {"gender_distribution": {"male": {"pct": 60.0}}, "diversity_score": {"overall": None}}}
    paths = charts.save_report(spark, found, str(tmp_path))
    assert [p.rpartition("/")[2] for p in paths] == ["funnel.svg", "failures.svg", "gender.svg", "scores.svg"]
    tall = [float(r.get("height")) for r in et.parse(paths[0]).getroot().findall("{*}rect")[1:4]]
    assert [round(h / tall[0], 3) for h in tall] == [1.0, 0.8, 0.7]
    results = spark.createDataFrame([(0.0, 5, 0.2, 0.9, 8.0), (0.5, 5, 0.4, None, 7.0)], "synthetic_ratio double, n_total int, diversity_overall double, acoustic_overlap double, wer_eval double")
    paths = charts.save_ablation(results, str(tmp_path / "more"))
    assert len(paths) == 3 and all(len(et.parse(p).getroot().findall("{*}polyline")) == 1 for p in paths)
    assert charts.bars("none", [], ("x",)).startswith("<svg") and charts.lines("none", []).endswith("</svg>")
