from pyspark.sql import functions as F
from sluice.functions import media, numbers


def test_media(spark):
    def values(column, rows, schema):
        return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]

    x = F.col("x")
    assert values(media.source_kind(x), [(".PNG",), (".gif",), (".xyz",), (".opus",)], "x string") == ["image", "gif", "", "audio"]
    assert values(media.codec_arguments(x, "192k"), [(".mp3",), (".flac",), (".zip",)], "x string") == [["-c:a", "libmp3lame", "-b:a", "192k"], ["-c:a", "flac"], None]
    chain = media.filter_chain(F.col("i"), F.col("o"), F.col("n"), F.col("d"))
    assert values(chain, [(3.0, 2.5, True, 10.0), (0.0, 2.0, False, None), (None, None, False, 5.0)], "i double, o double, n boolean, d double") == ["afade=t=in:st=0:d=3,afade=t=out:st=7.5:d=2.5,loudnorm", "afade=t=out:st=0:d=2", ""]
    assert values(media.glyph(x), [("A",), ("small_g",), ("cap_z",), ("comma",), ("space",), ("u0041",), ("0x1F600",), ("nothing",), ("",)], "x string") == ["A", "g", "Z", ",", " ", "A", "😀", None, None]
    decision, saving = media.assess(F.col("c"), F.col("b"), 0.05, 0.07)
    rows = [("hevc", 0.04), ("h264", 0.06), ("h264", 0.5), ("hevc", 0.052), ("h264", None)]
    assert values(decision, rows, "c string, b double") == ["skip", "skip", "compress", "skip", "compress"]
    assert values(saving, rows, "c string, b double") == [0.0, 0.0, 0.85, 0.035, 0.3]
    assert values(media.plausible_length(F.col("a"), F.col("e")), [(0.2, 4.0), (0.3, 4.0), (6.1, 4.0)], "a double, e double") == [False, True, False]
    assert values(media.hex_colour(x), [("#FF8000",), ("zz",)], "x string") == [[255, 128, 0], [0, 255, 0]]
    assert values(media.first_score(x), [("x VMAF score: 93.5 y",), ("none",)], "x string") == [93.5, None]
    assert values(numbers.parse_time(x), [("1:2:3:4",), ("Infinity",)], "x string") == [223384.0, None]
