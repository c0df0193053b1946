"""Relations of the fact store. Rows are identified by natural keys: the shard (one
archive) and names, so shards merge by union and drop out by a filter."""

from __future__ import annotations

RELATIONS = {
    "shards": "shard_id string, coordinate string, filename string, sha256 string, size_bytes bigint, last_access_at timestamp, source string",
    "classes": "shard_id string, fqn string, kind string, super_fqn string, modifiers int, is_abstract boolean, source_file string",
    "class_interfaces": "shard_id string, class_fqn string, interface_fqn string",
    "methods": "shard_id string, class_fqn string, name string, descriptor string, return_fqn string, modifiers int",
    "annotations": "shard_id string, target_kind string, class_fqn string, method_name string, method_descriptor string, annotation_fqn string, attributes string",
    "beans": "shard_id string, bean_id bigint, config_fqn string, bean_type_fqn string, bean_name string, method_name string, method_descriptor string",
    "conditions": "shard_id string, target_kind string, class_fqn string, bean_id bigint, type string, ref_value string",
    "strings": "shard_id string, class_fqn string, method_name string, method_descriptor string, value string",
    "spi": "shard_id string, mechanism string, key string, impl_fqn string",
    "config": "shard_id string, prefix string, name string, type_fqn string, default_val string, description string, source_fqn string",
    "artifacts": "coordinate string, group_id string, artifact string, version string, parent string, depth int, path string",
    "lines": "path string, line int, text string",
}
