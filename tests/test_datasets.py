"""Raw tables of each kind to normalised events, encoded rows and sequences."""

import gzip
import json

from pyspark.sql import functions as F

from tributary.plans.datasets import AIR_QUALITY, CARDS, CHURN, LOANS, REVIEWS, with_line_number
from tributary.plans.jobs import Encoder, profile_table, sequence_table, text_table
from tributary.sources import tables

CARD_CSV = """User,Card,Year,Month,Day,Time,Amount,Use Chip,Merchant Name,Merchant City,Merchant State,Zip,MCC,Errors?,Is Fraud?
0,0,2002,9,1,06:21,$134.09,Swipe Transaction,3527213246127876953,La Verne,CA,91750.0,5300,,No
0,1,2002,9,1,06:42,$38.48,Swipe Transaction,-727612092139916043,ONLINE,,,5411,,No
0,0,2002,9,2,06:22,$-12.50,Chip Transaction,-727612092139916043,Monterey Park,CA,91754.0,5411,Bad PIN,Yes
1,0,2003,1,1,00:00,$1.00,Swipe Transaction,1,Rome,Italy,,5812,,No
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def card_events(spark, tmp_path):
    raw = tables.read_csv(spark, write(tmp_path / "cards.csv", CARD_CSV), CARDS.read_schema)
    return raw, CARDS.normalise(with_line_number(raw))


def test_card_transactions(spark, tmp_path):
    _, events = card_events(spark, tmp_path)
    assert events.columns[:14] == ["Use Chip", "Merchant State", "Errors?", "MCC", "Merchant Name", "Merchant City", "Zip",
                                   "Amount", "Hour", "total_minutes_from_last", "Year", "Month", "Day", "Is Fraud?"]
    rows = {(r["User"], r["Card"], r["Amount"]): r for r in events.collect()}
    third = rows[(0, 0, -12.5)]
    # The gap restarts per card: 06:21 on one day to 06:22 on the next.
    assert third["total_minutes_from_last"] == 1441.0
    assert rows[(0, 1, 38.48)]["total_minutes_from_last"] == 0.0
    assert third["Use Chip"] == "ChipTransaction" and third["Errors?"] == "BadPIN" and third["Is Fraud?"] == "True"
    assert rows[(0, 1, 38.48)]["Zip"] == "NAN" and third["Zip"] == "91754" and third["Hour"] == 6.0


def test_card_sequences_cross_cards_in_index_order(spark, tmp_path):
    raw, events = card_events(spark, tmp_path)
    encoder = Encoder.fit(events, CARDS.schema, depth=2)
    seqs = {r["User"]: r for r in sequence_table(events, encoder, length=2).collect() if r["seq_idx"] == 0}
    assert len(seqs[0]["input_ids"]) == 2 * 15 + 2 and seqs[0]["n_rows"] == 2 and seqs[1]["n_rows"] == 1
    assert sequence_table(events, encoder, length=2).where("User = 0").count() == 2
    wide, profiled = profile_table(CARDS, with_line_number(raw))
    assert wide.where("column = 'MCC'").first()["n_distinct"] == 3
    assert profiled.where("column = 'Amount' and stat = 'buckets'").first()["value"] == 32.0


def test_encoder_round_trip(spark, tmp_path):
    _, events = card_events(spark, tmp_path)
    encoder = Encoder.fit(events, CARDS.schema, depth=2)
    encoder.save(str(tmp_path / "encoder"))
    again = Encoder.load(spark, str(tmp_path / "encoder"), CARDS.schema)
    a, b = (sorted(map(repr, e.encode(events).collect())) for e in (encoder, again))
    assert a == b


def test_product_reviews(spark, tmp_path):
    path = tmp_path / "reviews.json.gz"
    records = [dict(reviewerID="A", asin="x 1", overall=5.0, unixReviewTime=120, verified=True, style={"Format:": " DVD"}),
               dict(reviewerID="A", asin="y", overall=1.0, unixReviewTime=0, verified=False)]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(map(json.dumps, records)))
    raw = tables.read_json_lines(spark, str(path), REVIEWS.read_schema, partitions=3)
    events = REVIEWS.normalise(with_line_number(raw))
    rows = {r["asin"]: r for r in events.collect()}
    assert events.columns[:4] == ["asin", "total_minutes_from_last", "verified", "overall"]
    assert rows["x1"]["total_minutes_from_last"] == 2.0 and rows["y"]["verified"] == "False" and rows["x1"]["User"] == "A"
    text = text_table(events, REVIEWS.schema, 5).first()["text"]
    assert text == ("asin:y total_minutes_from_last:0.0 verified:False overall:1.0 [ROW] "
                    "asin:x1 total_minutes_from_last:2.0 verified:True overall:5.0 [ROW]")


def test_bank_churn(spark, tmp_path):
    text = ("PERIOD;cl_id;MCC;channel_type;currency;TRDATETIME;amount;trx_category;target_flag;target_sum\n"
            "01/10/2017;0;5200;;810;21OCT17:00:00:00;5023.0;POS;0;0.0\n"
            "01/10/2017;0;6011;type1;810;12OCT17:12:24:07;20000.0;DEPOSIT;0;0.0\n")
    path = tmp_path / "churn.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write(text)
    events = CHURN.normalise(with_line_number(tables.read_csv(spark, str(path), CHURN.read_schema, ";")))
    rows = {r["MCC"]: r for r in events.collect()}
    assert rows["5200"]["channel_type"] == "NAN" and rows["5200"]["User"] == 0
    assert rows["5200"]["total_minutes_from_last"] == 8 * 1440 + 11 * 60 + 36


def test_loans(spark, tmp_path):
    text = ("trans_id;account_id;type;operation;amount;balance;k_symbol;bank;event_time;labels;loan_time\n"
            "2;7;PRIJEM;VKLAD;10.5;20;;;60;1;0\n1;7;VYDAJ;;1;19;SIPO;AB;0;1;0\n")
    raw = tables.read_csv(spark, write(tmp_path / "loans.csv", text), LOANS.read_schema, ";")
    rows = {r["trans_id"]: r for r in LOANS.normalise(raw).collect()}
    assert rows[2]["total_minutes_from_last"] == 1.0 and rows[2]["k_symbol"] == "NAN" and rows[1]["operation"] == "NAN"


def test_air_quality_keeps_dotted_labels_in_the_middle(spark, tmp_path):
    head = "No,year,month,day,hour,PM2.5,PM10,SO2,NO2,CO,O3,TEMP,PRES,DEWP,RAIN,wd,WSPM,station\n"
    for name, wd in (("A", "N"), ("B", "")):
        write(tmp_path / f"{name}.csv", head + "".join(
            f"{i},2013,3,1,{i},{i}.5,2,3,4,5,6,7,8,9,0,{wd},1,{name}\n" for i in range(4)))
    raw = tables.read_csv(spark, str(tmp_path), AIR_QUALITY.read_schema)
    events = AIR_QUALITY.normalise(raw)
    schema = AIR_QUALITY.schema
    assert schema.label_position("PM2.5") == 6 and schema.label_position() == 16
    rows = events.collect()
    assert len(rows) == 8 and {r["wd"] for r in rows} == {"N", "NAN"} and {r["total_minutes_from_last"] for r in rows} == {0.0, 60.0}
    encoder = Encoder.fit(events, schema, depth=2)
    seq = sequence_table(events, encoder, length=5, label="PM2.5").where("station = 'A'").first()
    assert seq["n_rows"] == 4 and len(seq["input_ids"]) == 5 * schema.n_cols + 2
    # Constant columns do not split and keep their raw value.
    assert "8_2.0" not in [r["token"] for r in encoder.vocabulary.collect()]
    assert "7_2.0" in [r["token"] for r in encoder.vocabulary.collect()]
