"""Session catalogues of the five public corpora, each a plan over a listing of files and what was read from them.

A listing has the column ``path``; ``files`` makes one with Spark's own reader, so any store that Spark reads will do, and
no content is read for it.  Probes are rows (path, n_frames, fps) of video headers.  Every catalogue has the columns sid,
dataset, subject, session, fps, n_frames and duration_s, and those of its corpus; what cannot be read is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import image_timestamps, person_and_scene, trial_kind

# Capture rates in Hz, recorded lights, tasks and the people that two parts of a corpus share.
COHFACE_FPS, BELT_FS = 20.0, 32.0
LIGHTS = {"0": "lamp", "1": "lamp", "2": "natural", "3": "natural"}
TRIAL_FPS, TRIAL_STRIDE, BELT = 60.9708, 2, "Resp"
TASKS = {"01": "steady", "02": "talking", "03": "slow_translation", "04": "fast_translation", "05": "small_head_rotation", "06": "medium_head_rotation"}
MOVING = ("03", "04", "05", "06")
SAME_PERSON = {"8-gt": "b42", "10-gt": "b42", "after-exercise": "b42"}
FIRST, SECOND = "DATASET_1", "DATASET_2"
DEFAULT_FPS = 30.0


def files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def _part(path: str, k: int) -> Column:
    """The k-th part of a path from its end; 1 is the file's name."""
    return F.element_at(F.split(F.col(path), "/"), -k)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _sid(dataset: str, subject: Column, session: Column) -> list[Column]:
    return [F.concat_ws("_", F.lit({"vitalvideo": "VV"}.get(dataset, dataset.upper())), subject, session).alias("sid"), F.lit(dataset).alias("dataset"), subject.alias("subject"), session.alias("session")]


def numbered_folders(listing: DataFrame) -> DataFrame:
    """Rows (folder, subject, session, path) of files two folders deep whose folder names are numbers."""
    rows = listing.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), _part("path", 3).alias("subject"), _part("path", 2).alias("session"), "path")
    return rows.where(F.col("subject").rlike("^[0-9]+$") & F.col("session").rlike("^[0-9]+$"))


def cohface(listing: DataFrame, probes: DataFrame, lights: DataFrame | None = None) -> DataFrame:
    """Folders subject/session with data.avi; the header's rate counts where it agrees with the documented one.

    ``lights`` has (folder, light) as recorded; where it has none the session's number tells.
    """
    own = numbered_folders(listing)
    names = own.groupBy("folder", "subject", "session").agg(
        F.max(F.when(_part("path", 1) == "data.avi", F.col("path"))).alias("video"), F.max(F.when(_part("path", 1) == "data.hdf5", F.col("path"))).alias("hdf5")
    )
    rows = names.where("video is not null").join(probes.withColumnRenamed("path", "video"), "video").where("n_frames >= 2")
    rows = rows.withColumn("fps", F.when(F.abs(F.col("fps") - COHFACE_FPS) < 0.5, F.col("fps")).otherwise(COHFACE_FPS))
    mapped = _map(LIGHTS)[F.col("session")]
    if lights is not None:
        rows = rows.join(lights, "folder", "left")
        mapped = F.coalesce(F.when(F.col("hdf5").isNotNull(), F.col("light")), mapped)
    return rows.select(*_sid("cohface", F.col("subject"), F.col("session")), "fps", "n_frames", (F.col("n_frames") / F.col("fps")).alias("duration_s"), "video", "hdf5", mapped.alias("illumination"), F.lit(BELT_FS).alias("resp_fs"))


def recorded_lights(attributes: DataFrame) -> DataFrame:
    """Rows (folder, light) of the root attributes of data.hdf5 files that tell one."""
    rows = attributes.where((_part("path", 1) == "data.hdf5") & (F.col("name") == "illumination") & F.col("value").isNotNull())
    return rows.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.col("value").alias("light"))


def session_xml(spark: SparkSession, root: str) -> DataFrame:
    """Rows (folder, subject, vid_rate) of all session.xml below a folder; subjects without an id are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "session.xml").load(root)
    return parse_session_xml(rows.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.col("content").cast("string").alias("xml")))


def parse_session_xml(rows: DataFrame) -> DataFrame:
    """Rows (folder, subject, vid_rate) from (folder, xml).  Ids with an underscore would break session ids; rates that are
    no positive numbers cannot be used."""
    parsed = rows.select("folder", F.from_xml("xml", "subject struct<_id:string>, _vidRate string", {"mode": "PERMISSIVE"}).alias("x"))
    rate = F.coalesce(F.when(F.col("x._vidRate") == "", None).otherwise(F.col("x._vidRate")), F.lit(str(TRIAL_FPS))).try_cast("double")
    found = parsed.select("folder", F.col("x.subject._id").alias("subject"), rate.alias("vid_rate"))
    return found.where((F.length("subject") > 0) & ~F.col("subject").contains("_") & (F.col("vid_rate") > 0) & (F.col("vid_rate") < float("inf")))


def mahnob(listing: DataFrame, people: DataFrame, belts: DataFrame, stimuli: DataFrame, camera: str = "C1 trigger", neutral: bool = True) -> DataFrame:
    """Folders with exactly one colour video, a recording with a belt, a trial of known kind and a stimulus window.

    ``people`` is (folder, subject, vid_rate), ``belts`` (path, belt_fs) of recordings with the belt's channel, ``stimuli``
    (path, start_s, end_s, n_edges).
    """
    name = _part("path", 1)
    found = listing.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", name.alias("name")).groupBy("folder").agg(
        F.count_if(F.col("name").contains(camera) & F.col("name").endswith(".avi")).alias("videos"),
        F.min(F.when(F.col("name").contains(camera) & F.col("name").endswith(".avi"), F.col("path"))).alias("video"),
        F.min(F.when(F.col("name").endswith(".bdf"), F.col("path"))).alias("bdf"),
    )
    rows = found.where("videos = 1 and bdf is not null").join(people, "folder").join(belts.withColumnRenamed("path", "bdf"), "bdf").join(stimuli.withColumnRenamed("path", "bdf"), "bdf")
    span = F.col("end_s") - F.col("start_s")
    rows = rows.withColumns({"trial": trial_kind(_part("bdf", 1)), "stim_span_s": span, "n_src_frames": F.floor(span * F.col("vid_rate")).cast("long")})
    rows = rows.withColumns({"n_frames": F.ceil(F.col("n_src_frames") / TRIAL_STRIDE).cast("long"), "fps": F.col("vid_rate") / TRIAL_STRIDE})
    rows = rows.where(F.col("trial").isNotNull() & (F.col("n_frames") >= 2) & (F.lit(neutral) | (F.col("trial") == "S")))
    return rows.select(
        *_sid("mahnob", F.col("subject"), F.element_at(F.split("folder", "/"), -1)), "fps", "n_frames", (F.col("n_frames") / F.col("fps")).alias("duration_s"), "video", "bdf", "trial", "vid_rate",
        F.lit(TRIAL_STRIDE).alias("decimate"), "n_src_frames", F.col("start_s").alias("stim_onset_s"), F.col("end_s").alias("stim_end_s"), "stim_span_s", F.col("n_edges").alias("n_trigger"), "belt_fs",
    )


def pure(listing: DataFrame) -> DataFrame:
    """Folders dd-dd/dd-dd of images whose names are nanoseconds; the rate is that of the stamps."""
    rows = listing.select(_part("path", 2).alias("folder"), _part("path", 3).alias("outer"), _part("path", 1).alias("name")).where(F.col("folder").rlike("^[0-9]{2}-[0-9]{2}$") & (F.col("folder") == F.col("outer")))
    stamps = image_timestamps(rows, ["folder"], "name").withColumnRenamed("stamps", "timestamps_ns")
    span = (F.element_at("timestamps_ns", -1) - F.col("timestamps_ns")[0]) / 1e9
    found = stamps.withColumns({"n_frames": F.size("timestamps_ns").cast("long"), "duration_s": span, "task": F.split("folder", "-")[1]}).where("n_frames >= 2 and duration_s > 0")
    return found.select(
        *_sid("pure", F.split("folder", "-")[0], F.col("task")), ((F.col("n_frames") - 1) / F.col("duration_s")).alias("fps"), "n_frames", "duration_s", "task",
        F.coalesce(_map(TASKS)[F.col("task")], F.lit("unknown")).alias("task_name"), F.col("task").isin(*MOVING).alias("head_motion"), "timestamps_ns",
    )


def ubfc_layout(listing: DataFrame) -> DataFrame:
    """Rows (part, folder, subject, session, video, reference): numbered folders of both parts; a person who is in both has one
    name."""
    rows = listing.select(_part("path", 3).alias("part"), _part("path", 2).alias("folder"), _part("path", 1).alias("name"), "path")
    one, two = F.regexp_extract("folder", "^([0-9]+)-gt$", 1), F.regexp_extract("folder", "^subject([0-9]+)$", 1)
    number = F.when(F.col("part") == FIRST, one).when(F.col("part") == SECOND, two).try_cast("long").cast("string")
    alias = F.when(F.col("part") == FIRST, _map(SAME_PERSON)[F.col("folder")])
    rows = rows.withColumns({"number": number, "alias": alias}).where(F.col("number").isNotNull() | F.col("alias").isNotNull())
    subject = F.coalesce("alias", F.concat(F.when(F.col("part") == FIRST, "a").otherwise("b"), "number"))
    session = F.when(F.col("part") == SECOND, "d2").when(F.col("number").isNull(), "d1afterex").when(F.col("alias").isNotNull(), F.concat(F.lit("d1gt"), "number")).otherwise("d1gt")
    reference = F.when(F.col("part") == FIRST, "gtdump.xmp").otherwise("ground_truth.txt")
    return rows.groupBy("part", "folder", subject.alias("subject"), session.alias("session")).agg(F.max(F.when(F.col("name") == "vid.avi", F.col("path"))).alias("video"), F.max(F.when(F.col("name") == reference, F.col("path"))).alias("reference"))


def ubfc(listing: DataFrame, headers: DataFrame) -> DataFrame:
    """``headers`` is (path, width, height, fps, declared, found, bottom_up) of raw videos: frames declared and found."""
    rows = ubfc_layout(listing).where("video is not null").join(headers.withColumnRenamed("path", "video"), "video").where("found >= 2")
    return rows.select(*_sid("ubfc", F.col("subject"), F.col("session")), "fps", F.col("found").alias("n_frames"), (F.col("found") / F.col("fps")).alias("duration_s"), "part", "folder", "video", "reference", "width", "height", "bottom_up", F.col("declared").alias("n_frames_header"), (F.col("found") != F.col("declared")).alias("truncated"))


def vitalvideo(listing: DataFrame, probes: DataFrame, subsets: tuple[str, ...]) -> DataFrame:
    """Files <subset>/<person>_<scene>.mp4; a header without a rate has the default one."""
    rows = listing.select("path", _part("path", 2).alias("subset"), F.regexp_extract(_part("path", 1), "^(.*)[.]mp4$", 1).alias("stem")).where(F.col("subset").isin(*subsets) & F.col("stem").contains("_"))
    person, scene = person_and_scene(F.col("stem"))
    rows = rows.join(probes, "path").where("n_frames >= 2").withColumn("fps", F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(DEFAULT_FPS)))
    return rows.select(*_sid("vitalvideo", person, scene), "fps", "n_frames", (F.col("n_frames") / F.col("fps")).alias("duration_s"), "subset", F.col("path").alias("video"))
