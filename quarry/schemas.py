"""Schemas of the tables that operators exchange."""

from __future__ import annotations

FINDINGS = "video_id string, rule_id string, severity string, category string, title string, detail string, locator string, seq long"
BOXES = "video_id string, box_id long, parent_id long, type string, type_raw binary, start long, header int, size long, depth int, path string, uuid binary"
ANOMALIES = "video_id string, path string, offset long, code string, message string"
SAMPLES = "video_id string, track_no int, handler string, sample_no long, offset long, size long"
SAMPLE_RUNS = "video_id string, track_no int, sample_no long, a long, b long, parts array<struct<offset:long,size:long>>"
TRACKS = "video_id string, track_no int, handler string, n_sizes long, n_samples long, total_bytes long, unreachable_samples long, truncated boolean, error string"
METADATA = "video_id string, source string, key string, value string, dtype int, value_offset long, value_len long"
SEI = "video_id string, sample_no long, offset long, type int, size int, uuid string, payload binary"
NALS = "video_id string, sample_no long, offset long, size long, nal_type int"
SPS = "profile_idc int, level_idc int, chroma_format_idc int, width int, height int, frame_mbs_only boolean, crop array<int>"
FRAMES = "video_id string, idx long, t double, w int, h int, pix binary"
AUDIO = "video_id string, sr int, chunk_no int, pcm array<float>"
REGIONS = "video_id string, x int, y int, w int, h int, grad double, fill double"
PATCHES = "video_id string, offset long, data binary, zero_len long, kind string, label string"
TRIALS = "video_id string, encoder string, ladder_rank int, attempt int, crf int, metric string, mean double, p1 double, projected long"
PROBE = (
    "format struct<format_name:string,duration:string,size:string,bit_rate:string,tags:map<string,string>>, "
    "streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,nb_frames:string,"
    "duration:string,bit_rate:string,color_transfer:string,pix_fmt:string,sample_rate:string,channels:int,tags:map<string,string>,disposition:map<string,int>>>, "
    "chapters array<struct<id:long,start_time:string,end_time:string,tags:map<string,string>>>"
)
