"""Declared schemas of the relations that the engine passes around."""

BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double,score:double,label:string>"
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
DETECTIONS = f"path string, frame_ord bigint, ord bigint, box {BOX}"
EXAMPLES = f"idx bigint, path string, n bigint, box {BOX}"
SCANNED = "path string, frame_ord bigint"
CROPS = f"idx bigint, window {BOX}, detection {BOX}, paste_box {BOX}, scale double"
RAW_PREDICTIONS = "path string, cx double, cy double, w double, h double, obj double, cls array<double>"

CORNERS = ("x_min", "y_min", "x_max", "y_max")
DEFAULT_LABEL = "ship"
DEFAULT_SCORE = 1.0
