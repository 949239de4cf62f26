"""Column schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Measurement keys of a captured element, by type.
NUMBERS = """layoutDeviation fontBaselineDeviation chartBarCount chartBarBaselineSpread
textCollisionCount maxTextCollisionArea unseparatedTextBoundaryCount minimumAdjacentTextGap
scrollWidth clientWidth scrollHeight clientHeight ancestorClipOverflowInlineStart
ancestorClipOverflowInlineEnd ancestorClipOverflowBlockStart ancestorClipOverflowBlockEnd
concealedInteractiveDescendantCount concealedInteractiveDescendantCountX
concealedInteractiveDescendantCountY navigationLinkCount navigationGroupCount
textInsetInlineStart textInsetInlineEnd textInsetBlockStart textInsetBlockEnd textInsetTop
textInsetRight textInsetBottom textInsetLeft paddingInlineStart paddingInlineEnd
paddingBlockStart paddingBlockEnd paddingTop paddingRight paddingBottom paddingLeft lineCount
fontSize lineHeight minimumLineGap occludedFraction""".split()
FLAGS = """obscuredByModal fontMismatch isTextFlow hasText containsScrollRegionX
containsScrollRegionY clippedByAncestor insideScrollRegionX insideScrollRegionY
intentionalTruncation descendantClipped isScrollRegion isScrollRegionX isScrollRegionY
containsScrollRegion isBoxControl isVisualContainer hasVisualSurface isMultiline paintedText
openDialog dialogModalIntent modalDialog dialogFocusContained""".split()
TEXTS = """layoutAxis fontFamily expectedFontFamily collidingTextSelector overflowX overflowY
clippingAncestorSelector writingMode occludedBy targetException layoutParentSelector
readingHierarchySelector equivalenceGroup equivalenceEvidence equivalenceAxis
sourceOwnershipKey paletteRole""".split()
NESTED = {
    "table": "struct<scrollable:boolean,scrollbarVisible:boolean,affordance:boolean,"
    "rowCount:double,headerCount:double>",
    "focusVisibility": "struct<fullyVisible:boolean,occludedBy:string,occludedFraction:double>",
    "targetSpacing": "struct<status:string>",
    "focusIndicator": "struct<visible:boolean,changed:boolean,distinguishable:boolean,"
    "perceptibleProperties:array<string>,area:double,minimum_area:double>",
    "navigation": "struct<identity:string,truncated:boolean,destinations:array<string>>",
}
TYPES = (
    {k: "double" for k in NUMBERS}
    | {k: "boolean" for k in FLAGS}
    | {k: "string" for k in TEXTS}
    | NESTED
)
MEASUREMENTS = "struct<" + ",".join(f"{k}:{t}" for k, t in TYPES.items()) + ">"
ELEMENT = (
    "struct<kind:string,tag:string,role:string,name:string,selector:string,order:int,"
    "bounds:struct<x:double,y:double,width:double,height:double>,styles:map<string,string>,"
    f"states:map<string,boolean>,measurements:{MEASUREMENTS}>"
)
CAPTURE = (
    "capture_id string, url string, scenario string, state string, "
    "viewport struct<name:string,width:int,height:int>, truncated boolean, "
    f"elements array<{ELEMENT}>"
)


def measured(**known: Column) -> Column:
    """Measurement struct with the given keys set and all others NULL."""
    return F.struct(
        *[
            (known[k].cast(t) if k in known else F.lit(None).cast(t)).alias(k)
            for k, t in TYPES.items()
        ]
    )


def with_measurements(df: DataFrame, **known: Column) -> DataFrame:
    return df.withColumn("m", measured(**known))
