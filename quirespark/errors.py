"""Errors with the codes that callers see."""


class QuireError(Exception):
    code = "Error"
    kind = "InternalError"


def _error(code: str, kind: str) -> type[QuireError]:
    return type(code, (QuireError,), {"code": code, "kind": kind, "__module__": __name__})


# The codes of each kind.
DocumentAlreadyInIndex = _error("DocumentAlreadyInIndex", "Conflict")
DocumentNotFoundInIndex = _error("DocumentNotFoundInIndex", "NotFound")
PreferenceNotFound = _error("PreferenceNotFound", "NotFound")
UnknownMetadataCorrectionId = _error("UnknownMetadataCorrectionId", "NotFound")
UnknownIndexField = _error("UnknownIndexField", "BadRequest")
UnknownMetadataField = _error("UnknownMetadataField", "BadRequest")
WrongFieldType = _error("WrongFieldType", "BadRequest")
NoSearchCriteria = _error("NoSearchCriteria", "BadRequest")
QueryTooComplex = _error("QueryTooComplex", "BadRequest")
UnparsableQuery = _error("UnparsableQuery", "BadRequest")
UnknownSort = _error("UnknownSort", "BadRequest")
BadAltoFileFormat = _error("BadAltoFileFormat", "BadRequest")
BadMetadataFileFormat = _error("BadMetadataFileFormat", "BadRequest")
IndexFieldNotAggregatable = _error("IndexFieldNotAggregatable", "BadRequest")
NoFieldRequestedForAggregation = _error("NoFieldRequestedForAggregation", "BadRequest")
WordOffsetNotFound = _error("WordOffsetNotFound", "BadRequest")
BadOffsetForImageSnippet = _error("BadOffsetForImageSnippet", "BadRequest")
