"""Table schemas as DDL. Optional columns are nullable; times are epoch milliseconds, durations seconds."""

VIDEOS = (
    "id long not null, path string not null, path_key string not null, name string not null, dir string not null, ext string not null, "
    "size long not null, mtime_ms long not null, duration double, width long, height long, video_codec string, frame_count long not null, "
    "status string not null, error string, added_at long not null, indexed_at long, folder_id long, thumbnail binary, "
    "processed_timestamps array<long> not null, processed_ms long not null, file_hash string, sampling_override string"
)
#: The 16 words of the structure hash are columns of their own, so pruning reads dhash first and stays in generated code.
STRUCT_WORDS = [f"s{i}" for i in range(16)]
FRAMES = (
    "video_id long not null, frame_index long not null, time_ms long not null, dhash long not null, "
    + ", ".join(f"{w} long not null" for w in STRUCT_WORDS)
    + ", color array<int> not null, color_total long not null, spatial array<int> not null"
)
FOLDERS = (
    "id long not null, path string not null, path_key string not null, name string not null, pinned boolean not null, enabled boolean not null, "
    "recursive boolean not null, watch_state string not null, message string, added_at long not null, last_scan_at long"
)
SETTINGS = ("key string not null, value string")
SCENE_CACHE = ("video_id long not null, cache_key string not null, scene_times string")
EVENTS = (
    "revision long not null, type string not null, video struct<id:long,path:string,name:string,status:string,folder_id:long,added_at:long,size:long,duration:double>, "
    "video_id long, path string, folder_id long, level string, message string, done long, total long, id long, processed long, added long, skipped long, failed long, finished boolean"
)
