"""Fixed schemas of the media library's tables, as DDL strings."""

from __future__ import annotations

METADATA = "struct<date:string,camera_make:string,camera_model:string,lens:string,iso:string,f_number:string,exposure:string,focal_length:string,orientation:string,width:string,height:string,gps_lat:double,gps_lon:double>"
MEDIA = (
    f"uid string, path string, filename string, extension string, size_bytes bigint, created_at double, sig string, media_type string, duration_s double, width int, height int, codec string, metadata {METADATA}, "
    "dup_paths array<string>, caption string, caption_json string, caption_model string, caption_history array<struct<model:string,caption_json:string>>, dhash string"
)
FACES = "image_id string, face_index int, bbox array<double>, embedding array<double>"
CLUSTERS = "cluster_id int, size int, name string, status string, mean_embedding array<double>, members array<struct<image_id:string,face_index:int,bbox:array<double>,fp:string>>"
PERSONS = "name string, embedding array<double>"
RELATIONS = "name string, relation string, is_family boolean"
ALBUMS = "album_id string, name string, created_at string, image_ids array<string>"
TRASH = "id string, entry string, deleted_at double, file_deleted boolean"
FOLDERS = "path string, kind string, added_at string, last_scanned_at string, image_count bigint"
LISTING = "path string, size bigint, mtime double, sha1 string"
REGISTRY = "model string, source string, dimension int, first_used string, last_used string, is_active boolean"
