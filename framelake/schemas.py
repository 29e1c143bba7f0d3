"""Schemas of the entities; seconds are doubles for display, frame indices are the exact key."""

from __future__ import annotations

BALL_DET = "fid string, frame_idx int, det_idx int, sec double, conf double, x1 int, y1 int, x2 int, y2 int, cx int, cy int"
PERSON_BOX = "fid string, frame_idx int, box_idx int, x1 int, y1 int, x2 int, y2 int"
FRAME = "fid string, frame_idx int, sec double"
HOOP_DET = "fid string, frame_idx int, det_idx int, conf double, cx int, cy int"
CANDIDATE = "fid string, label string, t0 double, dur double, ac double, cx int, cy int, src string"
TRACK_POINT = "struct<sec:double,cx:int,cy:int,src:string>"
HOOP_EVENT = f"fid string, event_idx int, w0 double, w1 double, anchor_cx int, anchor_cy int, detected boolean, track array<{TRACK_POINT}>"
GOAL = "file string, anchor_time double, clip_start double, clip_end double, status string, scorer string"
SCORER_CANDIDATE = (
    "key string, file string, anchor_time double, status string, seed_frame int, seed_box array<int>, "
    "number_guess struct<number:string,color:string,name_text:string,confidence:string>, crops array<string>, crop string, crop_scores array<double>, team_guess string"
)
PLAYER = "tag string, name string, team string"
ASSIGNMENT = "key string, tag string"
EMBEDDING = "model_tag string, md5 string, vec array<double>"
TASK_EVENT = "ts string, task_id string, type string, line string"
# detection caches as written, one JSON document a file
BALL_JSON = "struct<conf:double,box:array<int>,cx:int,cy:int,sec:double,frame_idx:int>"
CACHE_JSON = f"frames int, balls array<array<{BALL_JSON}>>, persons array<array<array<int>>>, hoops array<array<struct<conf:double,cx:double,cy:double>>>, _corrupt_record string"
HOOPS_JSON = "events array<struct<fid:string,window:array<double>,anchor:array<double>,detected:boolean,track:array<array<string>>>>"
CANDIDATES_JSON = "fid string, label string, t0 double, dur double, ac double, cx int, cy int, src string"

#: Fixed values of the data: team names by first sign, and the sentinel tags.
BLACK, WHITE, CASUAL, OPPONENT = "黑", "白", "便服", "对手"
NO_GOAL, SKIP = "NOGOAL", "SKIP"
#: The keys that choose a player on the labelling page, in order.
PLAYER_KEYS = "123456789QWERTYUIADFHJKLCVB"
FPS = 5
