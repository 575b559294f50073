"""Rules over decoded containers, each a DataFrame of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import bitstream, boxes, rules
from quarry.operators import decoded, finders, intervals, media, sound, text_rules, tiles
from quarry.operators.decoded import PADDING, signatures
from quarry.operators.findings import all_findings, finding
from quarry.storage import stored

#: The shortest media gap that is reported.
GAP = 16
FACTS = decoded.TABLES["facts"]


def box_facts(files: DataFrame) -> DataFrame:
    """A row a box with what rules ask of its bytes; see ``decoded.fact_rows``."""
    return boxes.per_file(files, lambda video, data: decoded.fact_rows(video, data, boxes.parse(data)), FACTS)


def hash_named(files: DataFrame) -> DataFrame:
    return named_files(files.select("video_id", "path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256")))


def named_files(digests: DataFrame) -> DataFrame:
    """Files whose name is a hash of their content; ``digests``: video_id, path, md5, sha1, sha256."""
    from quarry.sources.files import stem

    rows = digests.withColumn("stem", stem(F.col("path")))
    hit = rows.filter(text_rules.named_by_hash(F.col("stem"), F.col("md5"), F.col("sha1"), F.col("sha256")))
    return finding(hit, "R1", "HIGH", "file", "named by its own hash", F.col("stem"))


def credentials(facts: DataFrame) -> DataFrame:
    """Content credentials: the known uuid, a marker in a uuid or jumb body, or a mark in any top box but media."""
    found = F.coalesce(F.col("marked"), F.lit(False)) | (F.coalesce("uuid", F.lit("")) == rules.C2PA_UUID) | (F.col("type") == "jumb") | F.col("named")
    hits = facts.filter(found).groupBy("video_id").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"))
    private = facts.filter("type = 'uuid'").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start")).join(hits, "video_id", "left_anti")
    return finding(hits, "R2", "HIGH", "credentials", "content credentials", F.col("n"), F.col("start")).unionByName(finding(private, "R2", "MED", "container", "private uuid boxes", F.col("n"), F.col("start")))


def protection(facts: DataFrame) -> DataFrame:
    """Protection boxes, with the systems that pssh boxes name, and protection names inside movie boxes where none was parsed."""
    systems = F.create_map(*[F.lit(x) for pair in rules.DRM_SYSTEMS for x in pair])
    parsed = facts.filter(F.col("type").isin(*rules.DRM_BOXES)).select("video_id", "type", "start", "system_id")
    inside = facts.filter("inside IS NOT NULL").select("video_id", F.explode("inside").alias("i")).select("video_id", "i.type", "i.start")
    hidden = inside.join(parsed.select("video_id", "type").distinct(), ["video_id", "type"], "left_anti").withColumn("system_id", F.lit(None).cast("string"))
    named = F.array_join(F.array_sort(F.collect_set(systems[F.col("system_id")])), ",")
    hits = parsed.unionByName(hidden).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), named.alias("systems"), F.min("start").alias("start"))
    return finding(hits, "R3", "HIGH", "protection", "protection boxes", F.concat_ws(" ", "n", F.nullif("systems", F.lit(""))), F.col("start"))


def structure(facts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Repeated, unknown and unprintable boxes, and parse anomalies."""
    top = facts.filter("depth = 0")
    twice = top.filter(F.col("type").isin("moov", "mdat", "ftyp")).groupBy("video_id", "type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unknown = top.filter(~F.col("type").isin(*boxes.TOP_TYPES)).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    odd = facts.filter(~F.col("type").rlike(r"^[\x20-\x7e¡-ÿ]{4}$") & ~F.contains("path", F.lit("/ilst/")) & ~F.startswith("type_hex", F.lit("000000")))
    odd = odd.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    broken = anomalies.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("start"))
    return all_parts(
        finding(twice, "R4", "MED", "container", F.concat(F.lit("repeated "), "type"), F.col("n")),
        finding(unknown, "R5", "MED", "container", "unknown top boxes", F.col("n"), F.col("start")),
        finding(odd, "R6", "MED", "container", "unprintable box names", F.col("n"), F.col("start")),
        finding(broken, "R7", F.when(F.col("n") > 2, "HIGH").otherwise("MED"), "container", "structure anomalies", F.col("n"), F.col("start")),
    )


def padding(facts: DataFrame) -> DataFrame:
    """Padding over 64 bytes with over 2 % non-zero bytes, each HIGH; one INFO where padding is clean."""
    rows = facts.filter(F.col("type").isin(*PADDING))
    bad = rows.filter("size > 64 AND nonzero > 0.02")
    clean = rows.select("video_id").distinct().join(bad, "video_id", "left_anti")
    return finding(bad, "R8", "HIGH", "hidden", F.concat(F.lit("data in padding "), "type"), F.concat_ws(" ", F.round("nonzero", 4), F.round("entropy", 3)), F.col("start")).unionByName(finding(clean, "R8", "INFO", "hidden", "padding is clean"))


def _media(top: DataFrame) -> DataFrame:
    return top.filter("type = 'mdat'").select("video_id", F.col("start").alias("box_id"), (F.col("start") + F.col("header")).alias("lo"), (F.col("start") + F.col("size")).alias("hi"))


def _holes(media_: DataFrame, used: DataFrame) -> DataFrame:
    """Stretches of media boxes that none of ``used`` (video_id, a, b) reaches."""
    inside = used.join(media_, "video_id").filter("b > lo AND a < hi").select("video_id", "box_id", F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b"))
    return intervals.complement(inside, media_, ["video_id", "box_id"])


def _as_runs(samples: DataFrame) -> DataFrame:
    """Samples in the form of ``boxes.sample_runs``, each by itself if they are single rows."""
    if "parts" in samples.columns:
        return samples
    end = F.col("offset") + F.col("size")
    return samples.select("video_id", "track_no", "sample_no", F.col("offset").alias("a"), end.alias("b"), F.array(F.struct("offset", "size")).alias("parts"))


def coverage(files: DataFrame, facts: DataFrame, samples: DataFrame) -> DataFrame:
    """Bytes after the last box, media bytes that no sample reaches, samples outside media or out of range.

    ``samples`` are single rows or ``boxes.sample_runs``: a run counts as one stretch, and
    only runs that lie badly are taken apart into their samples.
    """
    top = facts.filter("depth = 0")
    ends = files.select("video_id", "length").join(top.groupBy("video_id").agg(F.max(F.col("start") + F.col("size")).alias("end")), "video_id", "left")
    trailing = ends.withColumn("end", F.coalesce("end", F.lit(0))).filter("end < length")
    runs, media_ = _as_runs(samples), _media(top)
    used = runs.select("video_id", "track_no", "sample_no", "a", "b")
    holes = _holes(media_, used).withColumn("gap", F.col("b") - F.col("a"))
    total = media_.select("video_id").distinct().join(holes.groupBy("video_id").agg(F.sum(F.when(F.col("gap") >= GAP, F.col("gap"))).alias("counted"), F.sum("gap").alias("raw")), "video_id", "left")
    total = total.withColumns({"counted": F.coalesce("counted", F.lit(0)), "raw": F.coalesce("raw", F.lit(0))})
    outer = media_.select("video_id", F.col("lo").alias("a"), F.col("hi").alias("b"))
    wrong = "b < a OR a < 0 OR b > length"
    loose, beyond = intervals.not_contained(used, outer, ["video_id"]), used.join(files.select("video_id", "length"), "video_id").filter(wrong)
    parts = lambda odd: runs.join(odd.select("video_id", "track_no", "sample_no"), ["video_id", "track_no", "sample_no"], "left_semi").select("video_id", F.explode("parts").alias("p")).select("video_id", F.col("p.offset").alias("a"), (F.col("p.offset") + F.col("p.size")).alias("b"))
    if runs is samples:  # few runs, so what they are made of is met by their keys
        loose, beyond = intervals.not_contained(parts(stored(loose)), outer, ["video_id"]), parts(stored(beyond)).join(files.select("video_id", "length"), "video_id").filter(wrong)
    bad, outside = (rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")) for rows in (beyond, loose))
    return all_parts(
        finding(trailing, "R9", "HIGH", "hidden", "bytes after the last box", F.col("length") - F.col("end"), F.col("end")),
        finding(total, "R10", intervals.gap_severity(F.col("counted")), "hidden", "media bytes without samples", F.concat_ws(" ", "counted", "raw")),
        finding(bad, "R11", "HIGH", "container", "sample ranges out of the file", F.col("n")),
        finding(outside, "R12", "HIGH", "container", "samples outside media boxes", F.col("n")),
    )


def metadata_rules(items: DataFrame, dimension: DataFrame) -> DataFrame:
    """Images, fingerprints, hex and base64 strings and platform ids in metadata."""
    value, key = F.col("value"), F.col("key")
    images = items.filter(F.col("dtype").isin(12, 13, 14, 27) | (F.trim(key) == "covr"))
    prints = text_rules.rule_hits(items, ["video_id", "key"], "value", dimension)
    hexadecimal = text_rules.is_hex_like(value)
    ids = items.filter(text_rules.hits(value, "platform_id"))
    return all_parts(
        finding(images, "R13", "MED", "metadata", "embedded image", key, F.col("value_offset")),
        finding(prints, "R14", F.col("severity"), "metadata", F.col("code"), F.array_join("samples", " | "), key),
        finding(items.filter(hexadecimal), "R15", "MED", "metadata", "long hexadecimal value", value, key),
        finding(items.filter(~F.coalesce(hexadecimal, F.lit(False)) & text_rules.is_base64_like(value)), "R16", "MED", "metadata", "base64-like value", value, key),
        finding(ids, "R17", "HIGH", "metadata", "platform video id", value, key),
    )


def stream_rules(streams: DataFrame, probe: DataFrame) -> DataFrame:
    """Streams beyond one picture and one sound, cover and caption flags, chapters."""
    kinds = streams.groupBy("video_id").agg(F.count_if(F.expr("codec_type = 'video'")).alias("v"), F.count_if(F.expr("codec_type = 'audio'")).alias("a"), F.count_if(F.expr("codec_type NOT IN ('video', 'audio')")).alias("o"))
    flags = streams.select("video_id", "index", F.explode(F.map_filter("disposition", lambda k, v: (v > 0) & k.isin("attached_pic", "still_image", "timed_thumbnails", "captions", "descriptions"))).alias("flag", "_v"))
    chapters = probe.withColumn("n", F.size("chapters")).filter("n > 0")
    return all_parts(
        finding(kinds.filter("o > 0"), "R18", "HIGH", "streams", "streams neither picture nor sound", F.col("o")),
        finding(kinds.filter("v > 1"), "R18", "HIGH", "streams", "several video streams", F.col("v")),
        finding(kinds.filter("a > 1"), "R18", "MED", "streams", "several audio streams", F.col("a")),
        finding(flags, "R19", "MED", "streams", F.concat(F.lit("disposition "), "flag"), F.col("index")),
        finding(chapters, "R19", "LOW", "streams", "chapters", F.col("n")),
    )


def bitstream_rules(messages: DataFrame, parameters: DataFrame, videos: DataFrame, declared: DataFrame) -> DataFrame:
    """SEI messages by mark, and parameter sets whose size is not the declared one (video_id, width, height)."""
    marks = bitstream.sei_summary(messages)
    known = F.create_map(*[F.lit(x) for pair in rules.KNOWN_SEI_UUIDS for x in pair])
    user = messages.filter("type = 5").select("video_id", F.col("uuid").alias("mark")).distinct().withColumn("user", F.lit(True))
    graded = marks.join(user, ["video_id", "mark"], "left")
    severity = F.when(known[F.col("mark")].isNotNull(), "MED").when(F.col("user"), "HIGH").otherwise("MED")
    none = videos.join(messages.select("video_id").distinct(), "video_id", "left_anti")
    size = parameters.select("video_id", F.col("width").alias("w"), F.col("height").alias("h")).distinct().join(declared, "video_id").filter("w <> width OR h <> height")
    return all_parts(
        finding(graded, "R20", severity, "bitstream", F.concat(F.lit("SEI "), "mark"), F.col("n"), F.col("first_offset")),
        finding(none, "R20", "INFO", "bitstream", "no SEI messages"),
        finding(size, "R21", "MED", "bitstream", "coded and declared size differ", F.concat_ws("x", "w", "h")),
    )


def structural_segments(files: DataFrame) -> DataFrame:
    """``video_id, seg_start, text``: bytes outside media boxes as Latin-1, one row a top box, so no match spans a seam."""
    return boxes.per_file(files, lambda video, data: decoded.segment_rows(video, data, boxes.parse(data)), decoded.TABLES["segments"])


def string_rules(segments: DataFrame, dimension: DataFrame) -> DataFrame:
    """Fingerprints, urls, emails, addresses and uuids in structural bytes."""
    found = text_rules.intelligence(segments, ["video_id", "seg_start"], "text")
    severity = F.when(F.col("kind").isin("url", "uuid"), "MED").otherwise("LOW")
    prints = text_rules.rule_hits(segments, ["video_id", "seg_start"], "text", dimension)
    total = found.groupBy("video_id", "kind").agg(F.sum("n").alias("n"), F.min("seg_start").alias("seg_start"))
    return all_parts(
        finding(total, "R22", severity, "strings", F.col("kind"), F.col("n"), F.col("seg_start")),
        finding(prints, "F7", F.col("severity"), "strings", F.col("code"), F.array_join("samples", " | "), F.col("seg_start")),
    )


def signature_hits(files: DataFrame, most: int = 8) -> DataFrame:
    """``video_id, code, offset, ok``: embedded file signatures in structural bytes, ``most`` a signature and stretch, each validated."""
    return boxes.per_file(files, lambda video, data: decoded.signature_rows(video, data, boxes.parse(data), most), decoded.TABLES["signatures"])


def signature_rules(hits: DataFrame, videos: DataFrame) -> DataFrame:
    """MED once a kind of validated signature, INFO for videos without any."""
    good = hits.filter("ok").groupBy("video_id", "code").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n"))
    none = videos.join(good, "video_id", "left_anti")
    return finding(good, "R23", "MED", "hidden", F.concat(F.lit("embedded "), "code"), F.col("n"), F.col("offset")).unionByName(finding(none, "R23", "INFO", "hidden", "no embedded files"))


def deep_media_prints(media_text: DataFrame, dimension: DataFrame) -> DataFrame:
    """The first five fingerprints over media bytes (video_id, start, text), LOW."""
    prints = text_rules.rule_hits(media_text, ["video_id", "start"], "text", dimension.filter("rank < 5"))
    return finding(prints, "R24", "LOW", "media", F.col("code"), F.array_join("samples", " | "), F.col("start"))


def timing_rules(timing: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared frame counts that the samples contradict, zero-length samples, edit lists.

    ``timing``: video_id, handler, ordinal, samples, zero_deltas, edits; ``declared``: video_id,
    handler, ordinal, nb_frames.
    """
    frames = timing.join(declared, ["video_id", "handler", "ordinal"]).filter("nb_frames IS NOT NULL AND nb_frames <> samples")
    return all_parts(
        finding(frames, "R25", "MED", "timing", "declared and stored frames differ", F.concat_ws(" ", "nb_frames", "samples"), F.col("ordinal")),
        finding(timing.filter("zero_deltas > 0"), "R26", "LOW", "timing", "samples without duration", F.col("zero_deltas"), F.col("ordinal")),
        finding(timing.filter("edits > 0"), "R26", "LOW", "timing", "edit list", F.col("edits"), F.col("ordinal")),
    )


def timing_rows(files: DataFrame) -> DataFrame:
    """A row a track: handler, ordinal of its kind, duration, samples, zero steps, offsets, edits."""
    return boxes.per_file(files, lambda video, data: decoded.timing_rows(video, data, boxes.parse(data)), decoded.TABLES["timing"])


def fault_rules(faults: DataFrame) -> DataFrame:
    """LOW for every step that a file's bytes break (video_id, step, error); the other steps go on."""
    return finding(faults, "R32", "LOW", "scan", F.concat(F.lit("step failed: "), "step"), F.col("error"))


def unreferenced_bytes(lengths: DataFrame, facts: DataFrame, samples: DataFrame) -> DataFrame:
    """``video_id, a, b, kind``: bytes that nothing points to, as half-open stretches.

    ``trailing`` after the last top box, ``gap`` of ``GAP`` bytes or more in media boxes that
    no sample reaches, ``padding`` the bodies of padding boxes.  What a zero plan fills.
    """
    top = facts.filter("depth = 0")
    ends = lengths.select("video_id", "length").join(top.groupBy("video_id").agg(F.max(F.col("start") + F.col("size")).alias("a")), "video_id", "left")
    stretch = lambda rows, a, b, kind: rows.select("video_id", a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(kind).alias("kind")).filter("b > a")
    trailing = stretch(ends, F.coalesce("a", F.lit(0)), F.col("length"), "trailing")
    used = samples.select("video_id", F.col("offset").alias("a"), (F.col("offset") + F.col("size")).alias("b"))
    gaps = stretch(_holes(_media(top), used).filter(F.col("b") - F.col("a") >= GAP), F.col("a"), F.col("b"), "gap")
    padding_ = stretch(facts.filter(F.col("type").isin(*PADDING)), F.col("start") + F.col("header"), F.col("start") + F.col("size"), "padding")
    return all_parts(trailing, gaps, padding_)


def flash_rules(kinds: DataFrame, videos: DataFrame) -> DataFrame:
    """Flashes HIGH, none INFO; cuts INFO.  ``kinds`` has video_id and kind."""
    n = videos.join(kinds.groupBy("video_id").agg(F.count_if(F.expr("kind = 'flash'")).alias("flashes"), F.count_if(F.expr("kind = 'cut'")).alias("cuts")), "video_id", "left")
    n = n.fillna(0, ["flashes", "cuts"])
    return finding(n, "R30", F.when(F.col("flashes") > 0, "HIGH").otherwise("INFO"), "picture", "single-frame flashes", F.col("flashes")).unionByName(finding(n, "R30", "INFO", "picture", "cuts", F.col("cuts")))


def all_parts(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scan(
    files: DataFrame,
    probe: DataFrame | None = None,
    kinds: DataFrame | None = None,
    deep: bool = False,
    held: list[DataFrame] | None = None,
    frames: DataFrame | None = None,
    audio: DataFrame | None = None,
) -> DataFrame:
    """Every container rule over ``files`` (video_id, path, length, content), one findings table.

    ``probe`` (see ``sources.files.probes``) adds the rules on streams and declared sizes and
    frames, ``kinds`` (video_id, kind, idx where frames are given) those on flashes and cuts,
    ``frames`` (grey) those on overlays and finder patterns, ``audio`` those on sound; ``deep``
    looks into media bytes and at all samples.  Contents are decoded once, where they are
    read, and never shuffled.  The decoded tables are written below the shared folder; with
    ``held`` they are persisted and added to it instead, and its owner releases them once
    the findings are written.
    """
    from quarry.sources.files import streams

    spark = files.sparkSession
    dimension, videos = rules.fingerprints(spark), files.select("video_id")
    stream = decoded.tagged(files, deep)
    if held is None:
        stream = stored(stream)
    else:
        held.append(stream.persist())
    of = lambda name: decoded.table(stream, name)
    facts, samples, timing = of("facts"), of("samples"), of("timing")
    if probe is None:
        sizes = spark.createDataFrame([], "video_id string, width int, height int")
        declared = spark.createDataFrame([], "video_id string, handler string, ordinal int, nb_frames long")
        more = []
    else:
        every = streams(probe)
        sizes = every.filter("codec_type = 'video' AND ordinal = 1").select("video_id", "width", "height")
        handler = F.when(F.col("codec_type") == "video", "vide").when(F.col("codec_type") == "audio", "soun")
        declared = every.select("video_id", handler.alias("handler"), "ordinal", F.col("nb_frames").try_cast("long").alias("nb_frames")).filter("handler IS NOT NULL")
        more = [stream_rules(every, probe)]
    if kinds is not None:
        more.append(flash_rules(kinds, videos))
    if frames is not None:
        flashed = kinds.filter("kind = 'flash'") if kinds is not None and "idx" in kinds.columns else spark.createDataFrame([], "video_id string, idx long")
        shown = frames.select("video_id").distinct()
        more += [media.overlay_findings(tiles.overlay_regions(frames), shown), media.finder_findings(finders.finder_frames(frames), flashed, shown)]
    if audio is not None:
        more.append(media.ultrasonic_findings(sound.audio_spectra(audio)))
    if deep:
        more.append(deep_media_prints(of("media"), dimension))
    lengths = of("digests")
    return all_findings(
        [
            named_files(lengths),
            fault_rules(of("faults")),
            credentials(facts),
            protection(facts),
            structure(facts, of("anomalies")),
            padding(facts),
            coverage(lengths, facts, samples),
            metadata_rules(of("metadata"), dimension),
            bitstream_rules(of("messages"), of("parameters"), videos, sizes),
            string_rules(of("segments"), dimension),
            signature_rules(of("signatures"), videos),
            timing_rules(timing, declared),
            *more,
        ]
    )
