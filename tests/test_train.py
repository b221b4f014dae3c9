import json

from test_chrono import SCHEMA, card

from turfline.__main__ import main
from turfline import config as C
from turfline.operators import clean
from turfline.plans import train
from turfline.sources import files

HEADER = "Date of Race,Time,Track,Horse,Jockey,Trainer,Type,Pos,Runners,Forecasted Odds,Weight,Distance f,Official Rating,Going,Headgear,Class,Age,Stall,Days since last time out,Betfair SP"


def lines(rows, results=True):
    for x in rows:
        pos = "" if not results or x[9] is None else str(int(x[9]))
        yield f"{x[2]:%Y-%m-%d},{x[2]:%H:%M},{x[4]},{x[6]},{x[7] or ''},{x[8]},{x[21]},{pos},{x[20]},{x[22]},{x[13]},{x[14] / 201.168},{x[12]},{x[15]},{x[16]},{x[17] or ''},{x[18]},{x[19]},14,{2 + x[19]}"


def test_model_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(card(31, races=60), SCHEMA)
    train.save(spark, str(tmp_path), *_fitted(frame))
    scored = train.score(frame.drop("age"), str(tmp_path))
    got = scored.collect()
    assert len(got) == frame.count() and all(0 <= x.model_prob <= 1 for x in got)
    assert {"official_rating", "going", "model_prob", "race_id"} <= set(scored.columns)


def _fitted(frame):
    selected = ["official_rating", "going", "age", "weight_lbs"]
    model, calibrator, texts = train.fit(frame, frame, selected, trees=2)
    assert texts == ["going"]
    return model, calibrator, selected, texts


def test_cards_without_results_are_cleaned_for_scoring(spark, tmp_path):
    rows = card(31, races=20)
    header = HEADER.replace(",Pos", "")
    (tmp_path / "new.csv").write_text("\n".join([header, *(",".join(y for k, y in enumerate(line.split(",")) if k != 7) for line in lines(rows, False))]) + "\n")
    named = clean.standardize_names(files.read_cards(spark, [str(tmp_path / "new.csv")]))
    new = clean.prepare_inputs(clean.clean(named, scoring=True))
    assert new.count() == len(rows) and new.where("pos is not null or won = 1").count() == 0
    kinds = dict(new.dtypes)
    assert kinds["official_rating"] == "double" and kinds["age"] == "int" and kinds["distance_m"] == "double"


def test_from_card_files_to_scored_cards(spark, tmp_path):
    """The command line, from CSV to CSV, with the older market features, a stopped model and permutation importance."""
    rows = card(33, races=80)
    split = sorted({x[2] for x in rows})[-12]
    old, new = [x for x in rows if x[2] < split], [x for x in rows if x[2] >= split]
    (tmp_path / "old.csv").write_text("\n".join([HEADER, *lines(old)]) + "\n")
    header = HEADER.replace(",Pos", "")
    (tmp_path / "new.csv").write_text("\n".join([header, *(",".join(y for k, y in enumerate(line.split(",")) if k != 7) for line in lines(new, False))]) + "\n")
    artifacts = f"{tmp_path}/artifacts"
    train_it = ["train", "--cards", f"{tmp_path}/old.csv", f"{tmp_path}/missing.csv", "--artifacts", artifacts, "--trees", "3", "--permutation-repeats", "1"]
    main(train_it)
    report = json.loads(files.read_text(spark, f"{artifacts}/report.json"))
    assert report["kept"] > 0 and 1 <= report["trees"] <= 3 and "val_auc" in report and report["permutation"]
    assert json.loads(files.read_text(spark, f"{artifacts}/validation.json"))["rows"] == len(old)
    table = files.current(spark, f"{artifacts}/features.parquet")
    assert {"bsp_rank", "market_book_percentage", "horse_elo_pre_race", "course_specialist"} <= set(table.columns) and "pos" not in table.columns
    assert spark.read.option("header", True).csv(f"{artifacts}/importances").count() > 0
    marker = (tmp_path / "artifacts/features.parquet/CURRENT").read_text()
    main(["score", "--cards", f"{tmp_path}/new.csv", "--artifacts", artifacts, "--out", f"{tmp_path}/scored"])
    scored = spark.read.option("header", True).csv(f"{tmp_path}/scored").collect()
    assert len(scored) == len(new) and all(0 <= float(x.model_prob) <= 1 for x in scored)
    assert {(x.race_id, x.horse) for x in scored} == {(f"{x[2]:%Y-%m-%d}_{x[4].upper()}_{x[2]:%H:%M}", x[6]) for x in new}
    chosen = train.train_from_cards(spark, [f"{tmp_path}/old.csv", f"{tmp_path}/missing.csv"], artifacts, C.OLDER_SELECTION, trees=2)  # takes the table that is there
    assert (tmp_path / "artifacts/features.parquet/CURRENT").read_text() == marker
    assert chosen.importances is None and len(chosen.kept) > report["kept"]
