"""Tag templates: which tags a record of a modality has, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag keywords of the templates.
_IDENTITY = (
    "Modality", "StudyDate", "StudyInstanceUID", "SeriesInstanceUID", "PatientID", "AccessionNumber", "SeriesNumber", "SeriesDate",
    "SeriesTime", "SeriesDescription", "BodyPartExamined", "PatientPosition", "Manufacturer", "ManufacturerModelName", "StationName", "ProtocolName",
)
_PIXELS = ("Rows", "Columns", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "PhotometricInterpretation")
_VOLUME = ("NumberOfFrames", "NumberOfSeriesRelatedInstances", "SliceThickness", "PixelSpacing", "WindowCenter", "WindowWidth")
_EXPOSURE = ("KVP", "XRayTubeCurrent", "ExposureTime", "Exposure")
_PLACE = ("ImagePositionPatient", "ImageOrientationPatient")
_INSTANCE, _FILES = ("SOPInstanceUID", "InstanceNumber"), ("SamplesPerPixel", "FirstSOPInstanceUID", "MiddleSOPInstanceUID", "dcm", "metafilename")
_CT = ("FilterType", "GeneratorPower", "FocalSpots", "ConvolutionKernel", "SliceLocation", "ContrastBolusAgent")
_MR = (
    "RepetitionTime", "EchoTime", "InversionTime", "FlipAngle", "ScanningSequence", "SequenceVariant", "ScanOptions", "MRAcquisitionType", "EchoNumbers", "MagneticFieldStrength",
    "SpacingBetweenSlices", "EchoTrainLength", "PercentSampling", "PercentPhaseFieldOfView", "PixelBandwidth", "ContrastBolusAgent",
)
_DX = (
    "ViewPosition", "ImageLaterality", "PatientOrientation", "DetectorType", "DetectorConfiguration", "DetectorDescription", "DetectorID", "DateOfLastDetectorCalibration", "TimeOfLastDetectorCalibration",
    "ExposureIndex", "TargetExposureIndex", "DeviationIndex", "Sensitivity", "ImagerPixelSpacing", "WindowCenter", "WindowWidth",
)
_MG = (
    "ViewPosition", "ImageLaterality", "BreastImplantPresent", "PartialView", "OrganExposed", "AnodeTargetMaterial", "FilterMaterial", "CompressionForce", "BodyPartThickness",
    "ExposureControlMode", "ExposureControlModeDescription", "WindowCenter", "WindowWidth",
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "CT": _IDENTITY + _PIXELS + _VOLUME + _EXPOSURE + _CT + _INSTANCE + _PLACE + _FILES,
    "MR": _IDENTITY + ("ImageType",) + _PIXELS + _VOLUME + _MR + _INSTANCE + _PLACE + _FILES + ("b_value",),
    "DX": _IDENTITY + _PIXELS + _DX + _EXPOSURE + _INSTANCE + _FILES,
    "MG": _IDENTITY + _PIXELS + _MG + _EXPOSURE + _INSTANCE + _FILES,
}


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """``modality, tags`` from JSON arrays, one file a modality; a file that is no array has null tags."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return files.select(F.upper(F.regexp_replace("file", r"\.json$", "")).alias("modality"), F.from_json("value", "array<string>").alias("tags"))
