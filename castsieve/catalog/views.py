"""Channel, playlist and response data derived from the given tables.

The tables hold no playlists, so these views build them, row for row, from
``part``, ``documents`` and ``pages``.  Each is one SQL text that Spark and the
comparison database both run, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANNEL

CHANNELS_SQL = """
select id, name, tvg_name, group_name, link from (
select p_partkey id,
 concat(case p_partkey%8 when 0 then 'US: ' when 1 then 'FR | ' when 3 then '[DE] ' when 4 then '(HD) [IT] ' when 5 then 'Spanish ' when 6 then 'xx ' else '' end,
   p_name,' ',cast(p_size as varchar(10)),
   case p_partkey%5 when 1 then ' HD' when 2 then ' 4K' when 3 then '!' when 4 then ' 1080p' else '' end) name,
 case when p_partkey%3<>0 then null else concat(p_name,' ',cast(p_size as varchar(10))) end tvg_name,
 case p_partkey%6 when 0 then '' when 1 then 'Uncategorized' when 2 then upper(p_type) when 3 then lower(p_type) when 4 then 'Sports' else case p_partkey%24 when 5 then 'Kids TV' when 11 then 'Movie Zone' when 17 then 'MUSIC' else 'Spanish Docu' end end group_name,
 concat(case when p_partkey%97=0 then 'ftp://' when p_partkey%3=0 then 'HTTP://WWW.' else 'http://' end,
   case when p_partkey%83=0 then 'localhost' else concat('ex',cast(k%50 as varchar(10)),'.com') end,
   case when p_partkey%7=0 then ':80' else '' end,
   '/live/',cast(k as varchar(20)),
   case when p_partkey%89=0 then '.png' when p_partkey%11=0 then '/' else '' end,
   case p_partkey%4 when 1 then '?utm_source=x&b=2&a=1' when 2 then '?a=1&b=2' when 3 then '?t=9' else '' end) link
from (select *, case when p_partkey%5=0 then cast(floor(p_partkey/2.0) as bigint) else p_partkey - p_partkey%2 end k from part)
) c
"""

# Eight lines per channel: entry, noise, override, link in several places.
_SLOT_LINE = """
 case slot
 when 0 then case when id%29=0 then '#EXTINF:-1 tvg-name=""' when id%23=0 then concat('#EXTINF:-1 tvg-name="',p_n,'"')
   else concat('#EXTINF:-1 tvg-id="',cast(id as varchar(20)),'" tvg-name="',coalesce(tvg_name,''),'" a-b="1" A-B="2" tvg-language="English" x="" group-title="',group_name,'",',name) end
 when 1 then case when id%17=0 then '#EXTINF:0,stepped over' when id%3=0 then '' else '# comment' end
 when 2 then case when id%5=0 then concat('#EXTGRP: Grp ',cast(id%3 as varchar(5))) when id%7=0 then '#EXTGRP:' else '' end
 when 3 then case when id%13=0 then '' else link end
 when 4 then case when id%13=0 and id%2=0 then concat(link,'"') else '' end
 when 5 then case when id%13=0 and id%2=1 then link else '' end
 when 6 then case when id%31=0 then '  #extinf:-1,lower, case  ' else '' end
 else case when id%31=0 then concat('RTMP://ok.com/z',cast(id as varchar(20))) else '' end end"""

_SLOTS = "(values (0),(1),(2),(3),(4),(5),(6),(7)) s(slot)"

LINES_SQL = f"""
select concat('pl',cast(id%4 as varchar(5)),'.m3u') file, cast(floor(id/4.0) as bigint)*8+slot+1 line_no,
{_SLOT_LINE} line
from (select c.*, coalesce(tvg_name,'only tvg') p_n from channels_fx c) c cross join {_SLOTS}
union all
select * from (values ('pl0.m3u',cast(0 as bigint),'#EXTM3U x-tvg-url="http://epg.example/0"'),('pl1.m3u',cast(0 as bigint),'#extm3u url-tvg="http://epg.example/1"'),
 ('pl2.m3u',cast(0 as bigint),'#EXTM3U'),('pl3.m3u',cast(0 as bigint),'')) h(file,line_no,line)
"""

# The same lines as many small playlists of 50 channels each.
SMALL_LINES_SQL = f"""
select concat('small',cast(cast(floor(id/50.0) as bigint) as varchar(20)),'.m3u') file, (id%50)*8+slot+1 line_no,
{_SLOT_LINE} line
from (select c.*, coalesce(tvg_name,'only tvg') p_n from channels_fx c) c cross join {_SLOTS}
union all
select distinct concat('small',cast(n as varchar(20)),'.m3u') file, cast(0 as bigint) line_no,
 case n%4 when 0 then concat('#EXTM3U x-tvg-url="http://epg.example/',cast(n as varchar(20)),'"') when 1 then '#extm3u url-tvg="http://epg.example/one"' when 2 then '#EXTM3U' else '' end line
from (select cast(floor(id/50.0) as bigint) n from channels_fx) f
"""

RESPONSES_SQL = """
select link, id, attempt,
 case when id%10=0 then 404 when id%10=1 and attempt<2 then 503 when id%10=2 and attempt<3 then 500 when id%10=3 then 206 else 200 end status,
 case id%6 when 0 then '128' when 1 then 'abc' else null end icy_br,
 case id%12 when 0 then '' when 1 then hex('  <!DOCTYPE html><p>x')
  when 2 then hex(concat('#EXTM3U',chr(10),'#EXT-X-STREAM-INF:BANDWIDTH=1280000,RESOLUTION=1280x720,CODECS="avc1.4d,mp4a.40"'))
  when 3 then hex('#EXTM3U BANDWIDTH=9999999999') when 4 then concat('47',repeat('00',300)) when 5 then hex('FLV1') when 6 then hex('ID3x')
  when 7 then 'FFFB9000' when 8 then 'FFF15080' when 9 then hex('plain Not Found here') when 10 then hex(' 404 gone')
  else hex(repeat(concat('body',cast(id%60 as varchar(5))),60)) end body_hex
from channels_fx cross join (values (0),(1),(2),(3)) a(attempt)
"""

# Documents as channels: whole texts as names, sources as groups.
DOCUMENTS_SQL = """
select doc_id id, text name, cast(null as varchar(10)) tvg_name, source group_name,
 concat('http://docs.example.com/', lang, '/', cast(doc_id as varchar(20))) link
from documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_channels(df: DataFrame) -> DataFrame:
    """All channel columns, null or default where the view has none."""
    defaults = {
        "category": F.lit("Unknown"),
        "extra_attributes": F.create_map().cast("map<string,string>"),
    }
    return df.select(
        *[
            F.col(f.name)
            if f.name in df.columns
            else defaults.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in CHANNEL.fields
        ]
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = CHANNELS_SQL.replace("from part)", "from {part})")
    return as_channels(spark.sql(view, part=table(spark, sf_dir, "part")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_ord, file, line_no, line`` of four playlists."""
    view = spark.sql(LINES_SQL.replace("channels_fx", "{channels}"), channels=channels(spark, sf_dir))
    return view.withColumn("src_ord", F.lit(0))


def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_ord, file, text`` of many playlists with at most 401 lines each."""
    view = spark.sql(
        SMALL_LINES_SQL.replace("channels_fx", "{channels}"), channels=channels(spark, sf_dir)
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return view.groupBy("file").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text")
    ).select(F.lit(0).alias("src_ord"), "file", "text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = spark.sql(
        RESPONSES_SQL.replace("channels_fx", "{channels}"), channels=channels(spark, sf_dir)
    )
    return view.withColumn("body", F.unhex("body_hex")).drop("body_hex")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = DOCUMENTS_SQL.replace("from documents", "from {documents}")
    return as_channels(spark.sql(view, documents=table(spark, sf_dir, "documents")))


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the captured body of its link."""
    return documents(spark, sf_dir).select(
        "link",
        "id",
        F.lit(0).alias("attempt"),
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("icy_br"),
        F.encode("name", "UTF-8").alias("body"),
    )
