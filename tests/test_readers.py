"""CSV files of different encodings in one scan."""

from touchline.sources import readers

SCHEMA = "match_id int, home_team string, city string"


def test_each_file_has_its_own_encoding(spark, tmp_path):
    rows = {
        "mark": "\ufeffmatch_id,home_team,city\n1,Curaçao,\"São, Paulo\"\n".encode(),
        "utf8": "match_id,home_team,city\r\n2,Côte d'Ivoire,Zürich\r\n3,日本,\r\n".encode(),
        "latin": ("match_id,home_team,city\n" + "4,Peru,Lima\n" * 500 + "5,Curaçao,Zürich\n").encode("latin1"),
        "plain": b"match_id,home_team,city\n6,Peru,Lima\n", "empty": b"match_id,home_team,city\n",
    }
    for name, data in rows.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    paths = [str(tmp_path / f"{name}.csv") for name in rows]
    got = sorted(tuple(r) for r in readers.scan_csv_files(spark, paths, SCHEMA).distinct().collect())
    assert got == [
        (1, "Curaçao", "São, Paulo", "mark.csv"), (2, "Côte d'Ivoire", "Zürich", "utf8.csv"), (3, "日本", None, "utf8.csv"),
        (4, "Peru", "Lima", "latin.csv"), (5, "Curaçao", "Zürich", "latin.csv"), (6, "Peru", "Lima", "plain.csv")]
    assert readers.scan_csv(spark, paths, SCHEMA).count() == 505
    assert readers.scan_csv(spark, str(tmp_path / "mark.csv")).columns == ["match_id", "home_team", "city"]
    told = readers.scan_csv(spark, str(tmp_path / "latin.csv"), SCHEMA, "ISO-8859-1").where("match_id = 5").first()
    assert told.home_team == "Curaçao"
