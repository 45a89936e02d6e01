"""Planning of conversions as Column builders (survey V1, V3-V7, C13, P16). Nothing here decodes or encodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encoder by backend and codec.
ENCODERS = {
    "software/h264": "libx264", "software/h265": "libx265", "nvenc/h264": "h264_nvenc", "nvenc/h265": "hevc_nvenc", "qsv/h264": "h264_qsv", "qsv/h265": "hevc_qsv",
    "vaapi/h264": "h264_vaapi", "vaapi/h265": "hevc_vaapi", "amf/h264": "h264_amf", "amf/h265": "hevc_amf", "v4l2m2m/h264": "h264_v4l2m2m", "v4l2m2m/h265": "hevc_v4l2m2m",
}
#: Balanced quality by backend and codec, and what presets add.
QUALITY = {
    "software/h264": 18, "software/h265": 21, "auto/h264": 18, "auto/h265": 21, "qsv/h264": 18, "qsv/h265": 18, "nvenc/h264": 19, "nvenc/h265": 21,
    "vaapi/h264": 20, "vaapi/h265": 22, "amf/h264": 20, "amf/h265": 22, "v4l2m2m/h264": 18, "v4l2m2m/h265": 18,
}
PRESETS = {"higher": -3, "balanced": 0, "smaller": 4}
#: Backends in the order in which auto tries them.
AUTO = ("nvenc", "qsv", "vaapi", "amf", "v4l2m2m")
#: Fixed values by format: label, remapping token, stereo mode, filter of a packed picture, filter of two views.
LAYOUTS = {
    "full_sbs": ("Full side-by-side (3840×1080)", "sbsl", "left_right", "[0:v]null[v]", "[0:v][1:v]hstack=inputs=2[v]"),
    "half_sbs": ("Half side-by-side (1920×1080)", "sbs2l", "left_right", "[0:v]scale=iw/2:ih[v]", "[0:v]scale=iw/2:ih[l];[1:v]scale=iw/2:ih[r];[l][r]hstack=inputs=2[v]"),
    "full_tab": ("Full over/under (1920×2160)", "abl", "top_bottom", "[0:v]crop=iw/2:ih:0:0[l];[0:v]crop=iw/2:ih:iw/2:0[r];[l][r]vstack=inputs=2[v]", "[0:v][1:v]vstack=inputs=2[v]"),
    "half_tab": ("Half over/under (1920×1080)", "ab2l", "top_bottom", "[0:v]crop=iw/2:ih:0:0,scale=iw:ih/2[t];[0:v]crop=iw/2:ih:iw/2:0,scale=iw:ih/2[b];[t][b]vstack=inputs=2[v]", "[0:v]scale=iw:ih/2[t];[1:v]scale=iw:ih/2[b];[t][b]vstack=inputs=2[v]"),
    "frame_sequential": ("Frame-sequential (2× fps)", "al", None, "[0:v]crop=iw/2:ih:0:0[l];[0:v]crop=iw/2:ih:iw/2:0[r];[l][r]framepack=frameseq[v]", "[0:v][1:v]framepack=frameseq[v]"),
}


def _of(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _pair(backend: Column, codec: Column) -> Column:
    return F.concat(backend, F.lit("/"), codec)


def layout(fmt: Column) -> Column:
    """V1, V7: struct<label, token, stereo_mode, packed_filter, views_filter> of a format; frames in turn have no mode."""
    names = ("label", "token", "stereo_mode", "packed_filter", "views_filter")
    return F.struct(*(_of({f: v[i] for f, v in LAYOUTS.items() if v[i] is not None}, fmt).alias(n) for i, n in enumerate(names)))


def encoder(backend: Column, codec: Column) -> Column:
    """V4: null for auto."""
    return _of(ENCODERS, _pair(backend, codec))


def quality(preset: Column, backend: Column, codec: Column, override: Column | None = None) -> Column:
    """An override as it is, else the table's number from 12 to 32."""
    number = F.greatest(F.lit(12), F.least(F.lit(32), _of(QUALITY, _pair(backend, codec)) + _of(PRESETS, preset)))
    return number if override is None else F.coalesce(override, number)


def supports(backend: Column, codec: Column, encoders: Column, vaapi_device: Column, nvidia: Column, video_device: Column) -> Column:
    """V6: whether the encoder is listed and its device is there."""
    device = F.when(backend == "vaapi", vaapi_device.isNotNull()).when(backend == "nvenc", nvidia).when(backend == "v4l2m2m", video_device).otherwise(F.lit(True))
    return F.coalesce(F.array_contains(encoders, encoder(backend, codec)) & device, F.lit(False))


def resolve_backend(asked: Column, codec: Column, encoders: Column, vaapi_device: Column, nvidia: Column, video_device: Column) -> Column:
    """Auto takes the first supported backend; one that is asked for but not supported becomes software."""
    able = lambda b: supports(b, codec, encoders, vaapi_device, nvidia, video_device)
    first = F.coalesce(*(F.when(able(F.lit(b)), b) for b in AUTO), F.lit("software"))
    return F.when(asked == "auto", first).when(able(asked), asked).otherwise("software")


#: An encoder's arguments by backend, or by backend and codec; {q} is the quality, {rate} the bit rate.
RATE_ARGS = {
    "vaapi": "-qp {q}", "nvenc": "-preset p5 -rc vbr -cq {q}", "qsv": "-preset medium -global_quality {q}", "amf": "-quality balanced -rc cqp -qp_i {q} -qp_p {q} -qp_b {q}", "v4l2m2m": "-b:v {rate}M",
    "software/h264": "-preset medium -crf {q}", "software/h265": "-preset medium -crf {q} -x265-params open-gop=0:repeat-headers=1:info=0",
}


def encoder_args(backend: Column, codec: Column, quality: Column, vaapi_device: Column) -> Column:
    """V5: struct<init, upload_filter, args>; any other backend counts as software, any other codec there as h264."""
    rate = F.greatest(F.lit(0), F.lit(24) - F.floor(F.greatest(quality - 18, F.lit(0)) * 3 / 2)).cast("string")
    software = _of(RATE_ARGS, F.when(codec == "h265", "software/h265").otherwise("software/h264"))
    own = F.coalesce(_of(RATE_ARGS, F.when(backend != "software", backend)), software)
    own = F.replace(F.replace(own, F.lit("{q}"), quality.cast("string")), F.lit("{rate}"), rate)
    name = F.coalesce(encoder(backend, codec), encoder(F.lit("software"), codec))
    init = F.when((backend == "vaapi") & vaapi_device.isNotNull(), F.array(F.lit("-vaapi_device"), vaapi_device)).otherwise(F.array().cast("array<string>"))
    upload = F.when(backend == "vaapi", "format=nv12,hwupload")
    return F.struct(init.alias("init"), upload.alias("upload_filter"), F.concat(F.array(F.lit("-c:v"), name), F.split(own, " "), F.array(F.lit("-g"), F.lit("48"))).alias("args"))


def stereo_source(mvcc: Column, mode: Column) -> Column:
    """How a file's second view is stored, by its probe; null if it has none."""
    return F.when(mvcc.isNotNull(), "MvcWithBlockAdditions").when(mode.isin(13, 14), "MvcInlineLaced")
