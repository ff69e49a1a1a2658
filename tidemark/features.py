"""Protocol versions, table features, and properties of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemark.errors import TableError, UnsupportedFeature

#: Feature names of the format; which of them readers must know, and what we support (S scan, W write, C changes).
READER_WRITER = {
    "catalogManaged": "SW", "catalogOwned-preview": "SW", "columnMapping": "SWC", "deletionVectors": "SWC", "timestampNtz": "SWC", "typeWidening": "SC", "typeWidening-preview": "SC",
    "v2Checkpoint": "SWC", "vacuumProtocolCheck": "SWC", "variantType": "SWC", "variantType-preview": "SWC", "variantShredding-preview": "SWC",
}
WRITER = {
    "appendOnly": "W", "invariants": "W", "checkConstraints": "", "changeDataFeed": "W", "generatedColumns": "", "identityColumns": "", "inCommitTimestamp": "W", "rowTracking": "W", "domainMetadata": "W",
    "icebergCompatV1": "", "icebergCompatV2": "", "icebergCompatV3": "", "clustering": "W", "materializePartitionColumns": "W",
}
NEEDS = {"rowTracking": ("domainMetadata",), "clustering": ("domainMetadata",)}
#: What the numbered protocols stand for.
LEGACY_WRITER = {2: ("appendOnly", "invariants"), 3: ("checkConstraints",), 4: ("changeDataFeed", "generatedColumns"), 5: ("columnMapping",), 6: ("identityColumns",)}
P = "delta."


@dataclass(frozen=True)
class Protocol:
    reader: int = 1
    writer: int = 2
    reader_features: tuple[str, ...] | None = None
    writer_features: tuple[str, ...] | None = None

    @staticmethod
    def of(action: dict) -> Protocol:
        r, w = action.get("readerFeatures"), action.get("writerFeatures")
        return Protocol(action["minReaderVersion"], action["minWriterVersion"], None if r is None else tuple(r), None if w is None else tuple(w))

    @staticmethod
    def modern(features: set[str]) -> Protocol:
        """The protocol with just these features, in lists."""
        for f in list(features):
            features |= set(NEEDS.get(f, ()))
        return Protocol(3, 7, tuple(sorted(f for f in features if f in READER_WRITER)), tuple(sorted(features)))

    def action(self) -> dict:
        out: dict = {"minReaderVersion": self.reader, "minWriterVersion": self.writer}
        if self.reader >= 3:
            out["readerFeatures"] = list(self.reader_features or ())
        if self.writer >= 7:
            out["writerFeatures"] = list(self.writer_features or ())
        return out

    def check(self) -> None:
        if self.reader > 3 or self.writer > 7 or self.reader < 1 or self.writer < 1:
            raise UnsupportedFeature(f"protocol {self.reader}/{self.writer}")
        if (self.reader >= 3) != (self.reader_features is not None):
            raise UnsupportedFeature("reader features belong to reader version 3")
        if (self.writer >= 7) != (self.writer_features is not None):
            raise UnsupportedFeature("writer features belong to writer version 7")
        if self.reader_features and (wrong := [f for f in self.reader_features if f in WRITER or f not in (self.writer_features or ())]):
            raise UnsupportedFeature(f"not reader features, or not among the writer's: {wrong}")

    def features(self) -> set[str]:
        if self.writer_features is not None:
            return set(self.writer_features)
        out = {f for v, fs in LEGACY_WRITER.items() if v <= self.writer for f in fs}
        return out

    def gate(self, operation: str) -> None:
        """``operation``: S scan, W write or C change feed."""
        self.check()
        if operation in "SC":
            for f in self.reader_features or ():
                if operation not in READER_WRITER.get(f, ""):
                    raise UnsupportedFeature(f"reading needs {f}")
            return
        for f in self.features():
            if self.writer_features is None and f in ("checkConstraints", "generatedColumns", "identityColumns"):
                continue  # numbered protocols name them whether used or not; see ``Metadata``
            if operation not in {**READER_WRITER, **WRITER}.get(f, ""):
                raise UnsupportedFeature(f"writing needs {f}")
            for n in NEEDS.get(f, ()):
                if n not in self.features():
                    raise UnsupportedFeature(f"{f} needs {n}")


INTERVAL = re.compile(r"interval\s+(\d+)\s+(nanosecond|microsecond|millisecond|second|minute|hour|day|week)s?", re.I)
MILLIS = {"nanosecond": 1e-6, "microsecond": 1e-3, "millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def interval_ms(text: str) -> int:
    """An interval of one unit in milliseconds; months and negative ones are refused."""
    m = INTERVAL.fullmatch(text.strip())
    if not m:
        raise TableError(f"invalid interval {text!r}")
    return int(int(m[1]) * MILLIS[m[2].lower()])


def _yes(text: str) -> bool:
    return {"true": True, "false": False}[text.lower()]


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise ValueError(text)
    return n


def _columns(text: str) -> list[str]:
    return [re.sub(r"^`|`$", "", x.strip()) for x in re.findall(r"(?:`(?:[^`]|``)*`|[^,`])+", text)]


#: Known properties with their parsers and what they are without a value.
PROPERTIES = {
    "appendOnly": (_yes, False), "autoOptimize.autoCompact": (str, None), "autoOptimize.optimizeWrite": (_yes, None), "checkpointInterval": (_positive, 10),
    "checkpoint.writeStatsAsJson": (_yes, True), "checkpoint.writeStatsAsStruct": (_yes, False), "checkpointPolicy": (str, "classic"), "columnMapping.mode": (str, "none"), "columnMapping.maxColumnId": (int, None),
    "dataSkippingNumIndexedCols": (int, 32), "dataSkippingStatsColumns": (_columns, None), "deletedFileRetentionDuration": (interval_ms, 7 * 86_400_000), "enableChangeDataFeed": (_yes, False),
    "enableDeletionVectors": (_yes, False), "enableTypeWidening": (_yes, False), "isolationLevel": (str, None), "logRetentionDuration": (interval_ms, 30 * 86_400_000), "enableExpiredLogCleanup": (_yes, True),
    "minReaderVersion": (_positive, None), "minWriterVersion": (_positive, None), "randomizeFilePrefixes": (_yes, False), "randomPrefixLength": (_positive, 2), "setTransactionRetentionDuration": (interval_ms, None),
    "targetFileSize": (str, None), "tuneFileSizesForRewrites": (_yes, None), "enableInCommitTimestamps": (_yes, False), "inCommitTimestampEnablementVersion": (int, None), "inCommitTimestampEnablementTimestamp": (int, None),
    "enableRowTracking": (_yes, False), "rowTrackingSuspended": (_yes, False), "rowTracking.materializedRowIdColumnName": (str, None), "rowTracking.materializedRowCommitVersionColumnName": (str, None), "enableIcebergCompatV1": (_yes, False),
    "enableIcebergCompatV2": (_yes, False), "enableIcebergCompatV3": (_yes, False), "parquet.compression.codec": (str, None),
}


@dataclass
class Properties:
    """Parsed table properties; ``unknown`` keeps the rest, also known ones that cannot be parsed."""

    values: dict = field(default_factory=dict)
    unknown: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(configuration: dict[str, str]) -> Properties:
        out = Properties()
        for k, v in (configuration or {}).items():
            name = k.removeprefix(P)
            if not k.startswith(P) or name not in PROPERTIES:
                out.unknown[k] = v
                continue
            try:
                out.values[name] = PROPERTIES[name][0](v)
            except (ValueError, KeyError, TableError):
                out.unknown[k] = v
        return out

    def __getitem__(self, name: str):
        return self.values.get(name, PROPERTIES[name][1])
