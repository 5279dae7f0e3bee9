"""Schemas of the domain tables."""

from __future__ import annotations

MARKERS = "subject long, device string, marker_idx long, t double, value string"
SIGNALS = "recording long, channel string, ch_type string, pair_base string, sample_idx long, t double, x double"
FILES = "path string, file_name string, stem string, ext string, device string, size long"
DRIFT = "struct<offset:double,scale:double,r_squared:double,n_matches:int,method:string>"
DEVICE = f"struct<name:string,file_path:string,n_events:int,time_range:array<double>,raw_duration:double,drift_correction:{DRIFT}>"
MATCH_METADATA = f"struct<device_info:array<{DEVICE}>,timeline_metadata:struct<n_devices:int,device_names:array<string>,n_consensus_events:int,consensus_time_range:array<double>>>"
