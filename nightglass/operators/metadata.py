"""Typed, nested metadata from headers, in the two dialects.

FITS: the first alias in priority order wins, 32-bit numbers, right ascension
always times 15.  XISF: the last card in the document wins, and a value that
isn't a number resets the field; a numeric right ascension stays as it is, a
sexagesimal one is times 15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightglass import schemas as S
from nightglass.functions import scalars as X
from nightglass.functions import text as T
from nightglass.operators import headers as H

# Field, kind, FITS aliases in priority order, XISF aliases.
# Kinds: s string, f 32-bit, i integer, u unsigned of the first value, w 32-bit widened to 64 in the FITS dialect, b boolean.
FIELDS = {
    "equipment": [
        ("telescope_name", "s", "TELESCOP", "TELESCOP"), ("focal_length", "f", "FOCALLEN", "FOCALLEN"), ("aperture", "f", "APERTURE", "APERTURE"), ("focal_ratio", "f", "", "FOCRATIO"), ("reducer_flattener", "s", "", ""),
        ("mount_model", "s", "MOUNT", ""), ("focuser_position", "i", "FOCPOS FOCUSPOS", "FOCPOS FOCUSPOS"), ("focuser_temperature", "f", "FOCTEMP FOCUSTEMP", "FOCTEMP FOCUSTEMP"),
    ],
    "detector": [
        ("camera_name", "s", "INSTRUME CAMERA", "INSTRUME CAMERA"), ("pixel_size", "f", "PIXSIZE XPIXSZ", "XPIXSZ PIXSIZE"), ("width", "size", "NAXIS1", ""), ("height", "size", "NAXIS2", ""),
        ("binning_x", "bin", "XBINNING", "XBINNING"), ("binning_y", "bin", "YBINNING", "YBINNING"), ("gain", "f", "GAIN EGAIN", "GAIN EGAIN"), ("offset", "i", "OFFSET CCDOFFST", "OFFSET CCDOFFST"),
        ("readout_mode", "s", "READOUT READOUTM", "READOUT READOUTM"), ("usb_limit", "s", "USBLIMIT USBTRFC", "USBLIMIT USBTRFC"), ("read_noise", "f", "RDNOISE", "RDNOISE"), ("full_well", "f", "", ""),
        ("temperature", "f", "CCD-TEMP CCDTEMP", "CCD-TEMP CCDTEMP"), ("temp_setpoint", "f", "CCD-TEMP-SETPOINT SET-TEMP", "SET-TEMP"), ("cooler_power", "f", "COOL-PWR COOLPWR", ""), ("cooler_status", "s", "COOL-STAT COOLSTAT", ""),
        ("rotator_angle", "f", "ROTANG ROTPA ROTATANG", "ROTANG ROTPA ROTATANG"),
    ],
    "filter": [("name", "s", "FILTER", "FILTER"), ("position", "u", "FILTERID FLTPOS", ""), ("wavelength", "f", "WAVELENG WAVELEN", "")],
    "exposure": [
        ("object_name", "s", "OBJECT", "OBJECT"), ("ra", "ra", "RA OBJCTRA", "RA OBJCTRA"), ("dec", "dec", "DEC OBJCTDEC", "DEC OBJCTDEC"), ("date_obs", "t", "DATE-OBS", "DATE-OBS"), ("session_date", "none", "", ""),
        ("exposure_time", "f", "EXPTIME EXPOSURE", "EXPTIME EXPOSURE"), ("frame_type", "s", "IMAGETYP FRAME", "IMAGETYP FRAME"), ("sequence_id", "s", "SEQID SEQFILE", ""), ("frame_number", "u", "FRAMENUM SEQNUM", ""),
        ("dither_offset_x", "f", "DX DITHX", ""), ("dither_offset_y", "f", "DY DITHY", ""), ("project_name", "s", "PROJECT PROJNAME", "PROJECT PROJNAME"), ("session_id", "s", "SESSIONID SESSID", "SESSIONID SESSID"),
    ],
    "mount": [
        ("pier_side", "s", "PIERSIDE", "PIERSIDE"), ("meridian_flip", "b", "MFLIP MFOC", ""), ("latitude", "w", "SITELAT OBSLAT", "SITELAT OBSLAT"), ("longitude", "w", "SITELONG OBSLONG", "SITELONG OBSLONG"), ("height", "w", "SITEELEV OBSELEV", "SITEELEV OBSELEV"),
        ("guide_camera", "s", "GUIDECAM", ""), ("guide_rms", "f", "GUIDERMS", ""), ("guide_scale", "f", "GUIDESCALE", ""), ("dither_enabled", "b", "DITHER", ""), ("peak_ra_error", "f", "PEAKRA PEAKRAER", "PEAKRA PEAKRAER"), ("peak_dec_error", "f", "PEAKDEC PEAKDCER", "PEAKDEC PEAKDCER"),
    ],
    "environment": [
        ("ambient_temp", "f", "AMB_TEMP AMBTEMP", "AMB_TEMP AMBTEMP"), ("humidity", "f", "HUMIDITY", "HUMIDITY"), ("dew_heater_power", "f", "DEWPOWER DEWPWR", ""), ("voltage", "f", "VOLTAGE SYSVOLT", ""), ("current", "f", "CURRENT SYSCURR", ""),
        ("software_version", "software", "", ""), ("plugin_info", "s", "", ""), ("sqm", "f", "SQM SQMMAG SKYQUAL", "SQM SQMMAG SKYQUAL"),
    ],
    "wcs": [
        ("ctype1", "s", "CTYPE1", ""), ("ctype2", "s", "CTYPE2", ""), ("crpix1", "w", "CRPIX1", "CRPIX1"), ("crpix2", "w", "CRPIX2", "CRPIX2"), ("crval1", "w", "CRVAL1", ""), ("crval2", "w", "CRVAL2", ""), ("cd1_1", "w", "CD1_1", ""), ("cd1_2", "w", "CD1_2", ""),
        ("cd2_1", "w", "CD2_1", ""), ("cd2_2", "w", "CD2_2", ""), ("crota2", "w", "", ""), ("airmass", "f", "", ""), ("altitude", "f", "", ""), ("azimuth", "f", "", ""),
    ],
}
# The FITS keywords of which one must be there, in exact case, for the struct to be.
GATES = {
    "mount": ("PIERSIDE", "MFLIP", "GUIDERMS", "SITELAT", "OBSLAT"),
    "environment": ("AMB_TEMP", "HUMIDITY", "NINA-VERSION", "EKOS-VERSION", "SQM"),
    "wcs": ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2"),
}
_DDL = {g: S.METADATA[g] for g in FIELDS}


def gate(header: Column | str, group: str) -> Column:
    """Whether the header has one of the group's gate keywords."""
    keys = F.map_keys(X.col(header))
    return F.arrays_overlap(keys, F.array(*map(F.lit, GATES[group])))


def software_version(header: Column | str) -> Column:
    """'NINA <version>', else 'EKOS <version>', else the creator or software keyword."""
    s = lambda *a: H.first_string(header, a)
    return F.coalesce(F.concat(F.lit("NINA "), s("NINA-VERSION")), F.concat(F.lit("EKOS "), s("EKOS-VERSION")), s("SWCREATE", "SOFTWARE"))


def _fits_value(header: Column, kind: str, aliases: list[str], shape: Column | None, axis: int) -> Column:
    if kind == "s":
        return H.first_string(header, aliases)
    if kind in ("f", "w"):
        return H.first_float(header, aliases, "double" if kind == "w" else "float")
    if kind == "i":
        return H.first_integer(header, aliases)
    if kind == "u":
        return H.first_unsigned(header, aliases)
    if kind == "b":
        return F.coalesce(*[T.parse_flag(H.lookup(header, a)) for a in aliases])
    if kind == "bin":
        return F.coalesce(H.first_integer(header, aliases, "bigint", signed=False), F.lit(1))
    if kind == "size":
        found = F.coalesce(H.first_integer(header, aliases, "bigint", signed=False), F.lit(0))
        return found if shape is None else F.when(found > 0, found).otherwise(F.coalesce(F.get(shape, F.lit(axis)), F.lit(0)))
    if kind == "ra":
        return H.first_float(header, aliases, "double") * 15
    if kind == "dec":
        return H.first_float(header, aliases, "double")
    if kind == "t":
        return T.parse_date_time(H.lookup(header, aliases[0]))
    if kind == "software":
        return software_version(header)
    return F.lit(None)


def fits_group(header: Column | str, group: str, shape: Column | None = None) -> Column:
    """One struct of the FITS dialect; a gated one is null without a gate keyword.

    ``shape`` (width, height) stands in where NAXIS1 or NAXIS2 is missing.
    """
    header, fields = X.col(header), []
    for name, kind, aliases, _ in FIELDS[group]:
        if name == "focal_ratio":
            length, aperture = H.first_float(header, ["FOCALLEN"]), H.first_float(header, ["APERTURE"])
            value = F.when(X.positive(aperture), length / F.nullif(aperture, F.lit(0.0).cast("float")))
        elif name == "reducer_flattener":
            camera = H.first_string(header, ["INSTRUME"])
            value = F.when(camera.contains("reducer") | camera.contains("flattener"), camera)
        else:
            value = _fits_value(header, kind, aliases.split(), shape, int(name == "height")) if aliases or kind == "software" else F.lit(None)
        fields.append(value.alias(name))
    struct = F.struct(*fields).cast(_DDL[group])
    return F.when(gate(header, group), struct) if group in GATES else struct


def _among(names: list[str]):
    return lambda c: c["keyword"].isin(*names)


def _degrees(factor: int):
    return lambda c: F.coalesce(T.parse_number(c["value"], "float").cast("double"), T.parse_sexagesimal(c["value"]) * factor)


def xisf_group(cards: Column | str, group: str, xml: Column | None = None) -> Column:
    """One struct of the XISF dialect; mount, environment and wcs are null without any of their keywords."""
    cards, fields, some = X.col(cards), [], F.lit(False)
    for name, kind, _, aliases in FIELDS[group]:
        names = aliases.split()
        raw = H.last_of(cards, names) if names else F.lit(None).cast("string")
        if names:
            some = some | F.exists(cards, _among(names))
        if kind == "f":
            value = T.parse_number(raw, "float")
        elif kind == "w":
            value = T.parse_number(raw, "double")
        elif kind == "i":
            value = T.parse_integer(raw)
        elif kind == "bin":
            value = F.coalesce(T.parse_integer(raw, "bigint", signed=False), F.lit(1))
        elif kind in ("ra", "dec"):
            # a value that is neither keeps what came before, so the last good one counts
            held = F.filter(cards, _among(names))
            each = F.transform(held, _degrees(15 if kind == "ra" else 1))
            good = F.filter(each, lambda v: v.isNotNull())
            value = F.when(F.size(good) > 0, F.element_at(good, -1))
        elif kind == "t":
            value = T.parse_date_time(raw)
        elif kind == "size" and xml is not None:
            parts = F.split(T.xml_attribute(xml, "geometry"), ":")
            value = F.coalesce(F.when(F.size(parts) >= 2, T.parse_integer(F.get(parts, F.lit(int(name == "height"))), "bigint", signed=False)), F.lit(0))
        elif kind == "size":
            value = F.lit(0)
        elif kind == "software":
            value = T.xml_property(xml, "XISF:CreatorApplication") if xml is not None else F.lit(None).cast("string")
            some = some | value.isNotNull()
        else:
            value = raw if names else F.lit(None)
        fields.append(value.alias(name))
    struct = F.struct(*fields).cast(_DDL[group])
    return F.when(some, struct) if group in GATES else struct


def xisf_container(xml: Column | str) -> Column:
    """Version (the first in the text), creator, creation time and block alignment."""
    return F.struct(
        F.coalesce(T.xml_attribute(xml, "version"), F.lit("")).alias("version"), T.xml_property(xml, "XISF:CreatorApplication").alias("creator"),
        T.parse_date_time(T.xml_property(xml, "XISF:CreationTime")).alias("creation_time"), T.parse_integer(T.xml_attribute(xml, "blockAlignment"), "bigint", signed=False).alias("block_alignment"),
    ).cast(S.XISF)


def color_management(xml: Column | str) -> Column:
    """Colour space, presence of an ICC profile, and display function; null without any of them."""
    space, function = T.xml_attribute(xml, "colorSpace"), T.xml_attribute(xml, "displayFunction")
    profile = F.when(T.xml_property(xml, "ICCProfile").isNotNull(), F.lit(b""))
    empty = F.expr("cast(map() as map<string,double>)")
    display = F.when(function.isNotNull(), F.struct(function.alias("function_type"), F.coalesce(T.key_values(T.xml_attribute(xml, "displayParameters")), empty).alias("parameters")))
    made = F.struct(space.alias("color_space"), profile.alias("icc_profile"), display.alias("display_function")).cast(S.COLOR)
    return F.when(space.isNotNull() | profile.isNotNull() | function.isNotNull(), made)


def attachments(xml: Column | str) -> Column:
    """A struct for every ``<Image ...>`` tag."""
    a = T.xml_attribute
    empty = F.expr("cast(map() as map<string,string>)")

    def one(tag: Column, i: Column) -> Column:
        compression, checksum, x = a(tag, "compression"), a(tag, "checksumType"), a(tag, "xResolution")
        return F.struct(
            F.coalesce(a(tag, "id"), F.concat(F.lit("image"), i.cast("string"))).alias("id"), F.coalesce(a(tag, "geometry"), F.lit("")).alias("geometry"), F.coalesce(a(tag, "sampleFormat"), F.lit("UInt16")).alias("sample_format"),
            F.coalesce(T.parse_integer(a(tag, "bitsPerSample"), "bigint", signed=False), F.lit(16)).alias("bits_per_sample"), compression.alias("compression"),
            F.coalesce(F.when(compression.isNotNull(), T.key_values(a(tag, "compressionParameters"), kind="string")), empty).alias("compression_parameters"),
            checksum.alias("checksum_type"), F.when(checksum.isNotNull(), a(tag, "checksum")).alias("checksum"), T.parse_number(x, "double").alias("resolution_x"),
            F.when(x.isNotNull(), T.parse_number(a(tag, "yResolution"), "double")).alias("resolution_y"), F.when(x.isNotNull(), a(tag, "resolutionUnit")).alias("resolution_unit"),
        )

    return F.transform(T.xml_tags(xml, r"(?s)<Image [^>]*>"), one).cast(S.ATTACHMENTS)


def _with_session(df: DataFrame) -> DataFrame:
    made = X.session_date(F.col("exposure.date_obs"), F.col("mount.longitude"))
    return df.withColumn("exposure", F.col("exposure").withField("session_date", made))


def fits_metadata(scan: DataFrame, cards: str = "cards", shape: str | None = "shape") -> DataFrame:
    """Add the metadata structs to scanned FITS headers; only cards of the primary HDU count."""
    primary = F.filter(F.col(cards), lambda c: c["hdu_index"] == 0)
    df = scan.withColumn("raw_headers", H.header_map(primary))
    size = F.col(shape) if shape else None
    groups = {g: fits_group("raw_headers", g, size) for g in FIELDS}
    none = {g: F.lit(None).cast(S.METADATA[g]) for g in ("xisf", "color_management")}
    return _with_session(df.withColumns(groups | none | {"attachments": F.expr(f"cast(array() as {S.ATTACHMENTS})")}))


def xisf_metadata(scan: DataFrame, xml: str = "xml") -> DataFrame:
    """Add the metadata structs to scanned XISF headers."""
    df = scan.withColumn("cards", H.xisf_cards(xml))
    df = df.withColumn("raw_headers", H.header_map("cards"))
    groups = {g: xisf_group("cards", g, F.col(xml)) for g in FIELDS}
    return _with_session(df.withColumns(groups | {"xisf": xisf_container(xml), "color_management": color_management(xml), "attachments": attachments(xml)}))


def metadata(scan: DataFrame) -> DataFrame:
    """Metadata of a scan of both formats, each row by its own dialect, in one projection, so that files are read once."""
    is_fits, xml = F.col("format") == "fits", F.col("xml")
    df = scan.withColumn("cards", F.when(is_fits, F.col("cards")).otherwise(H.xisf_cards("xml")))
    df = df.withColumn("raw_headers", H.header_map(F.filter("cards", lambda c: c["hdu_index"] == 0)))
    groups = {g: F.when(is_fits, fits_group("raw_headers", g, F.col("shape"))).otherwise(xisf_group("cards", g, xml)) for g in FIELDS}
    only = {"xisf": F.when(~is_fits, xisf_container(xml)), "color_management": F.when(~is_fits, color_management(xml)), "attachments": F.when(is_fits, F.expr(f"cast(array() as {S.ATTACHMENTS})")).otherwise(attachments(xml))}
    return _with_session(df.withColumns(groups | only))
