"""The channel row."""

from pyspark.sql import types as T

LANGUAGE = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

STREAM_INFO = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("bitrate", T.IntegerType()),
        T.StructField("video_codec", T.StringType()),
        T.StructField("audio_codec", T.StringType()),
    ]
)

CHANNEL = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("group_name", T.StringType()),
        T.StructField("tvg_id", T.StringType()),
        T.StructField("tvg_name", T.StringType()),
        T.StructField("tvg_logo", T.StringType()),
        T.StructField("epg_url", T.StringType()),
        T.StructField("stream_info", STREAM_INFO),
        T.StructField("extra_attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("category", T.StringType()),
        T.StructField("language", LANGUAGE),
        T.StructField("content_hash", T.StringType()),
    ]
)

# Responses of links, captured by whoever may use the network.
RESPONSE = T.StructType(
    [
        T.StructField("link", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("icy_br", T.StringType()),
        T.StructField("body", T.BinaryType()),
    ]
)
