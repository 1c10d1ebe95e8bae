"""Exports written as one file and read again."""

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import public as V
from ..sources import onefile as O
from ..tables import NOTICES_SQL, NOW, Tables, notices
from ..workspace import own_folder
from .timing import STATUS_SQL, with_status


def _path(spark, name):
    return f"{own_folder(spark)}/export-{uuid.uuid4().hex}/{name}"


def _events(t):
    """Notices with the columns of the export; titles hold what cells must be guarded from."""
    id_ = F.col("id")
    title = F.when(id_ % 5 == 0, F.concat(F.lit(" =SUM("), id_, F.lit(")"))).when(id_ % 5 == 1, F.concat(F.lit('"so", '), id_)).when(id_ % 5 == 2, F.concat(F.lit("-"), id_)).otherwise(F.col("title"))
    told = {"title": title, "source_name": F.concat(F.lit("source "), F.col("source_id")), "registration_start": F.col("opened").cast("string"), "deadline": F.col("deadline").cast("string"), "deadline_time": F.col("deadline_time"), "status_label": F.col("status"), "url": F.concat(F.lit("https://x.org/"), id_)}
    return with_status(notices(t)).select("id", *[told.get(c, F.lit(None).cast("string")).alias(c) for c in O.CSV_COLUMNS.values()])


_TITLE = """case id % 5 when 0 then ' =SUM(' || id || ')' when 1 then '"so", ' || id when 2 then '-' || id else title end"""
_CELL = '''case id % 5 when 0 then chr(39) || ' =SUM(' || id || ')' when 1 then '"""so"", ' || id || '"' when 2 then chr(39) || '-' || id else title end'''
_HEAD = ",".join(O.CSV_COLUMNS)


@query(f"""with {NOTICES_SQL} select '{_HEAD}' as line union all
 select concat({_CELL}, ',source ', source_id, ',', opened, ',', deadline, repeat(',', 11), status, ',https://x.org/', id, ',,,', deadline_time) from (select *, {STATUS_SQL} as status from notices)""")
def export_csv(spark, d):
    """The CSV export, written as one file by tasks, and its lines as they stand; the reader takes the byte order mark away."""
    path = _path(spark, "events.csv")
    O.write_csv(_events(Tables(spark, d)), [F.col("deadline").desc(), F.col("id")], path)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


@query(f"with {NOTICES_SQL} select id, {_TITLE} as title, cast(deadline as varchar) as deadline, deadline_time, status as status_label, '{NOW}' as generated_at from (select *, {STATUS_SQL} as status from notices)")
def export_json(spark, d):
    """The JSON export, written as one document, and its items as a JSON reader gives them."""
    path = _path(spark, "data.json")
    rows = _events(Tables(spark, d)).select("id", "title", "deadline", "deadline_time", "status_label")
    O.write_json(rows, [F.col("id")], path, first={"version": 8, "generated_at": NOW})
    lines = spark.read.option("lineSep", "\n    {\n").text(path)  # items stand four blanks in
    items = lines.where(F.col("value").startswith('      "id"')).select(F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", r"\n    \}[\s\S]*$", "}")), "id long, title string, deadline string, deadline_time string, status_label string").alias("item"))
    return items.select("item.*", F.lit(NOW).alias("generated_at"))


@query("""select event_id, array_to_string(list_transform(range(0, least(8, event_id % 11 + 1)), lambda x: 'step' || x || ':' || 2 * x), ',') as steps,
 case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' when 1 then strftime(ts, '%Y-%m-%dT%H:%M') || ':00+00:00' end as stamp from events""")
def public_steps(spark, d):
    """Steps of a reading and stamps with an offset, as far as they may be shown."""
    number = F.col("event_id") % 11
    step = lambda i: F.create_map(F.lit("stage"), F.concat(F.lit("step"), i), F.lit("code"), (2 * i).cast("string"), F.lit("token"), F.lit("secret"))
    shown = F.transform(V.public_trace(F.transform(F.sequence(F.lit(0).cast("long"), number), step)), lambda s: F.array_join(F.map_values(s), ":"))
    at = lambda form: F.date_format("ts", form)
    which = F.col("event_id") % 4
    text = F.when(which == 0, F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit("+09:00"))).when(which == 1, F.concat(at("yyyy-MM-dd'T'HH:mm"), F.lit("Z"))).when(which == 2, at("yyyy-MM-dd'T'HH:mm:ss")).otherwise("yesterday")
    return Tables(spark, d).events.select("event_id", F.array_join(shown, ",").alias("steps"), V.zoned_stamp(text).alias("stamp"))
